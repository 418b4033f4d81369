"""Builds a project's model and graph, and answers plans and questions on it."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract import facts
from ..lineage import cut, shuffled
from ..model import LIMITS, SNIPPET, TOKEN_BUDGET
from ..operators import budget, evidence, graph, indexes, merge, resolve, search, traverse
from ..sources import scan
from . import plan as plans
from . import serialize


@dataclass
class Graph:
    """A built project: its model's tables, nodes, edges, files and when it was built."""

    tables: dict[str, DataFrame]
    nodes: DataFrame
    edges: DataFrame
    files: DataFrame
    built_at: str

    @property
    def meta(self) -> dict:
        return {"projectId": "project", "createdAt": self.built_at, "fileCount": self.files.count(), "symbolCount": self.tables["symbols"].count()}


def build(spark: SparkSession, root: str, files: DataFrame | None = None) -> Graph:
    """The whole way from a source tree (or a table of files) to a graph. All its tables are stored when it returns, by joins that send nothing to the driver."""
    with shuffled(spark):
        return _build(spark, root, files)


def _build(spark: SparkSession, root: str, files: DataFrame | None) -> Graph:
    files = scan.read_tree(spark, root) if files is None else files
    # Stored once: every table of facts comes from the same pass over the sources.
    extracted = cut(facts.extract(files))
    listed = files.select("file_seq", "path")
    name = os.path.basename(os.path.abspath(root)) or "project"
    model = merge.merge_partials(listed, facts.tables(extracted), f"project::{name}", name)
    model = {t: cut(df) for t, df in model.items()}
    found = resolve.resolve_all(model["refs"], model["symbols"], model["scopes"], model["containments"], model["local_bindings"], listed)
    model["containments"] = model["containments"].unionByName(cut(found.containments))
    model |= {"resolved_refs": found.resolved, "unresolved_refs": cut(found.unresolved), "diagnostics": model["diagnostics"].unionByName(cut(found.diagnostics)), "externals": cut(found.externals)}
    nodes, edges = graph.build_graph(model["symbols"], model["containments"], found.resolved)
    return Graph(model, cut(nodes), cut(edges), files, datetime.now(UTC).isoformat())


def from_rows(files: DataFrame, tables: dict[str, DataFrame]) -> Graph:
    """A graph of tables made elsewhere (symbols, containments, resolved_refs)."""
    nodes, edges = graph.build_graph(tables["symbols"], tables["containments"], tables["resolved_refs"])
    return Graph(tables, cut(nodes), cut(edges), files, datetime.now(UTC).isoformat())


class Engine:
    """Answers on one graph; `graph` may be swapped for a newer one at any time."""

    def __init__(self, graph_: Graph):
        self.graph = graph_

    def answer(self, plan: plans.Plan) -> dict:
        if wrong := plans.validate(plan):
            return {"status": "invalid", "errors": wrong}
        g = self.graph
        spark = g.nodes.sparkSession
        if plan.search_only:
            _, found = search.resolve_anchor(g.nodes, plan.anchors[0].query, "search", plan.anchors[0].kind)
            return {"status": "ok", "graphBuiltAt": g.built_at, "candidates": [r.asDict() for r in found.orderBy("rank").select("id", "kind", "qname", "path", "score").collect()]}
        anchors = search.resolve_all(g.nodes, [vars(a) for a in plan.anchors], True, plan.tolerate_missing)
        if anchors["status"] != "resolved":
            return {"status": anchors["status"], "graphBuiltAt": g.built_at, **anchors}
        ids = list(dict.fromkeys(anchors["ids"]))
        depth, most, most_paths = traverse.bounded(plan.depth, "depth"), traverse.bounded(plan.node_limit, "nodes"), traverse.bounded(plan.path_limit, "paths")
        start = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id string, rank long")
        paths, left_out = [], 0
        if plan.operation == "path":
            if len(ids) < 2:
                return {"status": "invalid", "errors": ["a path needs two different anchors"]}
            paths = [r.asDict() for r in traverse.paths(g.edges, ids[0], ids[1], plan.edge_kinds, depth, most_paths).orderBy("path_rank").collect()]
            on = spark.createDataFrame([(i, n) for n, i in enumerate(dict.fromkeys(i for p in paths for i in p["path"]))], "id string, rank long")
            nodes = g.nodes.join(F.broadcast(on), "id").withColumns({"distance": F.col("rank").cast("int"), "via": F.lit(None).cast("string")})
            edges = graph.subgraph_edges(g.edges.join(on.select(F.col("id").alias("src")), "src", "left_semi").join(on.select(F.col("id").alias("dst")), "dst", "left_semi"))
        elif plan.operation == "impact":
            nodes, edges = traverse.impact(g.nodes, g.edges, start.limit(1), depth, most)
        else:
            nodes, edges, left_out = traverse.region(g.nodes, g.edges, start, plan.direction, plan.edge_kinds, depth, most, LIMITS["edges"], LIMITS["per_file"])
        rows = self.materialize(nodes, edges, plan, tuple(ids))
        links = [r.asDict() for r in edges.orderBy("edge_seq").collect()]  # at most the edge limit, or edges among admitted nodes
        body = serialize.path(paths, rows) if plan.operation == "path" else serialize.impact(rows, links, ids[0]) if plan.operation == "impact" else serialize.region(rows, links, ids, left_out)
        head = self.head(plan, anchors, ids)
        text, was_cut = serialize.document(*head, body)
        return {"status": "ok", "graphBuiltAt": g.built_at, "anchors": ids, "nodes": rows, "edges": links, "paths": paths, "omittedEdges": left_out, "text": text, "truncated": was_cut, "tokens": -(-len(text) // 4)}

    def materialize(self, nodes: DataFrame, edges: DataFrame, plan: plans.Plan, ids: tuple[str, ...]) -> list[dict]:
        """An answer's nodes with sources, comments, call sites and levels: as many as the node limit admits."""
        g = self.graph
        # nodes are few; what is joined to them is not
        files = g.files.join(F.broadcast(nodes.select("path").distinct()), "path", "left_semi")
        shown = evidence.slices(evidence.roles(plan.operation, nodes, (ids[0], ids[-1])), files)
        lines = evidence.lines_of(files)
        if plan.docs:
            wants = shown.select("path", F.col("sl").alias("line_no")).where("line_no is not null").distinct()
            shown = shown.join(evidence.preceding_comments(wants, lines).withColumnRenamed("line_no", "sl"), ["path", "sl"], "left")
        else:
            shown = shown.withColumn("comment", F.lit(None).cast("string"))
        if "unresolved_refs" in g.tables:
            own = g.tables["unresolved_refs"].join(F.broadcast(nodes.select(F.col("id").alias("from_id"))), "from_id", "left_semi")
            shown = shown.join(graph.unresolved_index(own).withColumnRenamed("from_id", "id"), "id", "left")
        chars = F.length(F.coalesce("source", F.lit(""))) if plan.source else F.lit(0)
        base = sum((F.length(F.coalesce(F.col(c), F.lit(""))) for c in ("id", "name", "kind", "path", "signature", "comment")), F.lit(0))
        shown = cut(shown.withColumn("coverage", graph.coverage_state(F.col("kind"), F.col("test_covered"))))
        levels = budget.allocate(shown.select(F.col("rank").alias("seq"), "id", "kind", "role", base.alias("base"), chars.alias("source_chars")), plan.token_budget or TOKEN_BUDGET).select("id", "level")
        shown = cut(shown.join(levels, "id", "left"))
        rows = [r.asDict() for r in shown.orderBy("rank").collect()]
        spans = self.spans(shown, files) if plan.source else {}
        for r in rows:
            r.pop("source")
            r["text"], r["text_at"] = spans.get(r["id"], (None, None))
            r["unresolved"] = serialize.unresolved(r.pop("refs") or []) if "refs" in r else ""
        if plan.callsites:
            ends = nodes.select(F.col("id").alias("src"), "path", F.col("sl").alias("from_line"), F.col("el").alias("to_line"))
            names = nodes.select(F.col("id").alias("dst"), "name")
            wants = edges.where(F.col("kind").isin("call", "instantiate")).join(ends, "src").join(names, "dst").select("path", "src", "dst", "name", "from_line", "to_line")
            sites = {(s["src"], s["dst"]): s["line_no"] + 1 for s in evidence.callsites(wants, lines, "path", ("src", "dst")).collect()}
            for r in rows:
                r["callsites"] = {d: n for (s, d), n in sites.items() if s == r["id"]}
        return rows

    def spans(self, shown: DataFrame, files: DataFrame) -> dict[str, tuple[str, tuple[int, int]]]:
        """For each node that shows its source, the text and lines of the merged span that it lies in; a span without a whole source is cut to a snippet."""
        wide = shown.where(F.col("level").isin("FULL", "SNIPPET")).select("id", "path", "level", F.col("sl").alias("start_line"), F.col("el").alias("end_line"))
        merged = budget.merge_spans(wide, ("path",))
        texts = evidence.slices(merged.select("path", "span", F.col("start_line").alias("sl"), F.col("end_line").alias("el")), files).select("path", "span", "source")
        held = budget.spans_of(wide, merged, ("path",)).join(texts, ["path", "span"]).collect()
        whole = {(r["path"], r["span"]) for r in held if r["level"] == "FULL"}
        return {r["id"]: (r["source"] if (r["path"], r["span"]) in whole else (r["source"] or "")[:SNIPPET], (r["span_start"], r["span_end"])) for r in held}

    def head(self, plan: plans.Plan, anchors: dict, ids: list[str]) -> list[list[str]]:
        """What comes before the body: doubts, notes on picked anchors, flow, blast radius."""
        g = self.graph
        notes = [f"Note: '{q}' was taken as {i}; others: {', '.join(rest)}" for q, i, rest in anchors["notes"] if rest]
        if not plan.flow:
            return [notes]
        flows = [r.asDict() for r in traverse.flow_between(g.edges, ids).orderBy("flow_rank").collect()]
        asked, found = len(plan.anchors), len(ids)
        spark = g.nodes.sparkSession
        why = spark.range(1).select(traverse.confidence(F.lit(asked), F.lit(found), F.lit(len(flows))).alias("w")).first()["w"]
        start = spark.createDataFrame([(i,) for i in ids], "id string")
        blast = traverse.blast_radius(g.nodes, g.edges, start).collect()
        by = {r["id"]: r.asDict() for r in g.nodes.join(F.broadcast(spark.createDataFrame([(i,) for i in {*ids, *(i for f in flows for i in f["path"])}], "id string")), "id").collect()}
        doubt = [f"LOW CONFIDENCE: {why}"] if why else []
        flow = ["FLOW", *(" -> ".join(serialize.ref(by.get(i), i) for i in f["path"]) for f in flows)] if flows else []
        radius = ["BLAST RADIUS", *(f"- {r['id']}: {r['references']} references from {r['n_files']} files {r['files']}" + (" (no covering tests)" if r["no_tests"] else "") for r in blast)]
        return [doubt, notes, flow, radius]

    def retrieve(self, question: str, strategy: str | None = None) -> dict:
        """What belongs to a question in plain words: its strategy, symbols, steps and snippets."""
        g = self.graph
        spark = g.nodes.sparkSession
        strategy = strategy or spark.range(1).select(search.strategy(F.lit(question)).alias("s")).first()["s"]
        found = search.discover(g.nodes, question, 10)
        if found.isEmpty():
            return {"strategy": strategy, "symbols": [], "files": [], "steps": [], "snippets": []}
        start = cut(found.select("id", F.col("rank").cast("long").alias("rank")))
        nodes = {"locate": traverse.locate, "flow": traverse.flow, "impact": traverse.impacted}[strategy](g.nodes, g.edges, start)
        nodes = cut(nodes.where(~F.col("kind").isin("project", "file")))
        snippets = evidence.slices(nodes, g.files.join(nodes.select("path").distinct(), "path", "left_semi")).orderBy("rank").collect()
        steps = evidence.flow_steps(nodes, g.edges).orderBy("step").collect()
        return {"strategy": strategy, "symbols": [r["id"] for r in snippets], "files": sorted({r["path"] for r in snippets if r["path"]}), "steps": [(r["step"], r["src"], r["dst"], r["kind"]) for r in steps], "snippets": [(r["id"], (r["sl"] or 0) + 1, (r["el"] or 0) + 1, r["source"]) for r in snippets]}


def rebuild_file(spark: SparkSession, root: str) -> Graph:
    """After a change: everything again, since one file's change can move other files' references."""
    return build(spark, root)


def raw(engine: Engine, plan: dict) -> dict:
    return engine.answer(plans.from_dict(plan))


__all__ = ["Engine", "Graph", "build", "from_rows", "indexes", "raw", "rebuild_file", "replace"]
