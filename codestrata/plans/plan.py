"""The query plan, its checks, and its builders for each kind of question."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

OPERATIONS = ("region", "path", "impact")
DIRECTIONS = ("incoming", "outgoing", "both")
RESOLUTIONS = ("auto", "exact", "search")


@dataclass(frozen=True)
class Anchor:
    query: str
    mode: str = "auto"
    kind: str | None = None


@dataclass(frozen=True)
class Plan:
    operation: str
    anchors: tuple[Anchor, ...]
    direction: str = "both"
    depth: int | None = None
    node_limit: int | None = None
    path_limit: int | None = None
    edge_kinds: tuple[str, ...] = ()
    search_only: bool = False
    tolerate_missing: bool = False
    flow: bool = False
    source: bool = False
    callsites: bool = False
    signatures: bool = True
    docs: bool = False
    token_budget: int | None = None
    extra: dict = field(default_factory=dict)


def validate(plan: Plan) -> list[str]:
    """What is wrong with a plan; nothing: []."""
    wrong = []
    if plan.operation not in OPERATIONS:
        wrong.append(f"operation must be one of {', '.join(OPERATIONS)}")
    if not plan.anchors:
        wrong.append("at least one anchor is needed")
    for a in plan.anchors:
        if not isinstance(a.query, str) or not a.query.strip():
            wrong.append("an anchor needs a query")
        if a.mode not in RESOLUTIONS:
            wrong.append(f"resolution must be one of {', '.join(RESOLUTIONS)}")
    if plan.operation == "path" and len(plan.anchors) < 2:
        wrong.append("a path needs two anchors")
    if plan.direction not in DIRECTIONS:
        wrong.append(f"direction must be one of {', '.join(DIRECTIONS)}")
    for name in ("depth", "node_limit", "path_limit", "token_budget"):
        value = getattr(plan, name)
        if value is not None and (not isinstance(value, int) or isinstance(value, bool) or value < (0 if name == "depth" else 1)):
            wrong.append(f"{name} must be a whole number")
    if not all(isinstance(k, str) for k in plan.edge_kinds):
        wrong.append("edge kinds must be texts")
    return wrong


def search_symbols(query: str, kind: str | None = None, expand: bool = False, depth: int | None = None) -> Plan:
    anchor = (Anchor(query, "auto" if expand else "search", kind),)
    return Plan("region", anchor, "both", (1 if depth is None else depth) if expand else 0, 40 if expand else None, search_only=not expand)


def explore_region(anchors: list[str], direction: str = "outgoing", depth: int = 3, edge_kinds=(), **more) -> Plan:
    return Plan("region", tuple(map(Anchor, anchors)), direction, depth, edge_kinds=tuple(edge_kinds), **{"source": True} | more)


def trace_path(start: str, end: str, depth: int = 6, edge_kinds=(), **more) -> Plan:
    return Plan("path", (Anchor(start), Anchor(end)), "outgoing", depth, edge_kinds=tuple(edge_kinds), **{"callsites": True} | more)


def analyze_impact(anchor: str, depth: int = 3, **more) -> Plan:
    return Plan("impact", (Anchor(anchor),), "incoming", depth, **more)


def explore_flow(spark: SparkSession, question: str, depth: int = 1) -> Plan:
    """The question's words that look like names become anchors; those that nothing fits are left out."""
    from pyspark.sql import functions as F

    from ..operators.search import flow_terms

    terms = spark.range(1).select(flow_terms(F.lit(question)).alias("t")).first()["t"]
    return Plan("region", tuple(map(Anchor, terms)), "both", depth, tolerate_missing=True, flow=True, source=True, callsites=True, docs=True)


def from_dict(raw: dict) -> Plan:
    """A plan as callers write it in JSON."""
    limits, shown = raw.get("constraints", {}), raw.get("materialize", {})
    anchors = tuple(Anchor(a.get("query", ""), a.get("resolution", "auto"), a.get("kind")) for a in raw.get("anchors", []))
    return Plan(
        raw.get("operation", ""), anchors, limits.get("direction", "both"), limits.get("requestedDepth"), limits.get("requestedNodes"), limits.get("requestedPaths"), tuple(limits.get("edgeKinds", ())),
        tolerate_missing=bool(limits.get("tolerateMissingAnchors")), flow=bool(limits.get("synthesizeFlow")), source=bool(shown.get("source")), callsites=bool(shown.get("callsites")), signatures=shown.get("signatures", True), docs=bool(shown.get("docs")),
        token_budget=raw.get("context", {}).get("tokenBudget"),
    )
