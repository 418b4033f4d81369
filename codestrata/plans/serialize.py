"""Answers as text, from the bounded rows that an answer has."""

from __future__ import annotations

from ..model import RELATION_LINES, RESPONSE_CAP

VERBS = {"call": "calls", "instantiate": "creates", "import": "imports", "inherit": "extends", "implement": "implements", "type_use": "uses type", "renders": "renders", "owns": "owns", "has_member": "has member"}


def ref(node: dict | None, id_: str = "") -> str:
    if node is None:
        return f"[Omitted: {id_}]"
    return f"{node['qname'] or node['name']} ({node['path']}:{(node['sl'] or 0) + 1})"


def confidence(method: str | None) -> str:
    return " [low confidence]" if method == "global_fallback" else ""


def confidence_summary(edges: list[dict]) -> str:
    low = sum(e["method"] == "global_fallback" for e in edges)
    known = sum(e["method"] is not None for e in edges)
    return f"Resolution confidence: {known - low} high, {low} low" if known else ""


def unresolved(refs: list[dict]) -> str:
    """At most five unresolved names, each on one line and at most 40 characters long."""
    names = list(dict.fromkeys(" ".join(r["raw_name"].split())[:40] for r in refs))
    return ", ".join(names[:5]) + (f" +{len(names) - 5} more" if len(names) > 5 else "")


def coverage(state: bool | None) -> str:
    return "" if state is None else " [tested]" if state else " [no covering tests]"


def relations(edges: list[dict], nodes: dict[str, dict], anchors: set[str]) -> list[str]:
    lines = {f"{ref(nodes.get(e['src']), e['src'])} {VERBS.get(e['kind'], e['kind'])} {ref(nodes.get(e['dst']), e['dst'])}{confidence(e['method'])}": e["src"] in anchors or e["dst"] in anchors for e in reversed(edges)}
    order = sorted(reversed(list(lines)), key=lambda x: not lines[x])
    return order[:RELATION_LINES]


def reading_index(nodes: list[dict]) -> list[str]:
    """Files in order, their symbols by line; sources once for each merged span."""
    out, shown = [], set()
    for path in sorted({n["path"] for n in nodes if n["path"]}):
        out.append(f"## {path}")
        for n in sorted((n for n in nodes if n["path"] == path and n.get("level") != "OMIT"), key=lambda n: (n["sl"] or 0, n["id"])):
            out.append(f"- {n['kind']} {n['qname'] or n['name']}, line {(n['sl'] or 0) + 1}" + (f": {n['signature']}" if n.get("signature") else "") + coverage(n.get("coverage")) + (f" | unresolved: {n['unresolved']}" if n.get("unresolved") else ""))
            if n.get("comment"):
                out.append(n["comment"])
            if n.get("text") and n["level"] in ("FULL", "SNIPPET") and (path, n["text_at"]) not in shown:
                shown.add((path, n["text_at"]))
                out += ["```", n["text"], "```"]
    return out


def region(nodes: list[dict], edges: list[dict], anchors: list[str], left_out: int = 0) -> list[str]:
    by = {n["id"]: n for n in nodes}
    more = [f"({left_out} relationships left out)"] if left_out else []
    return ["# Anchors", *(f"- {ref(by.get(a), a)}" for a in anchors), confidence_summary(edges), "# Relationships", *relations(edges, by, set(anchors)), *more, "# Code", *reading_index(nodes)]


def path(paths: list[dict], nodes: list[dict]) -> list[str]:
    by = {n["id"]: n for n in nodes}
    if not paths:
        return ["No path was found within the limits."]
    out = ["# Paths"]
    for p in paths:
        out.append(" ".join([ref(by.get(p["path"][0]), p["path"][0]), *(f"--{k}--> {ref(by.get(i), i)}" for k, i in zip(p["kinds"], p["path"][1:], strict=True))]))
    return [*out, "# Code", *reading_index(nodes)]


def impact(nodes: list[dict], edges: list[dict], anchor: str) -> list[str]:
    by = {n["id"]: n for n in nodes}
    out = ["# Impact of", f"- {ref(by.get(anchor), anchor)}{coverage(by[anchor].get('coverage')) if anchor in by else ''}", confidence_summary(edges)]
    for d in sorted({n["distance"] for n in nodes} - {0}):
        out += [f"# Depth {d}", *(f"- {ref(n)} via {n['via']}{coverage(n.get('coverage'))}" for n in nodes if n["distance"] == d)]
    return [*out, "# Code", *reading_index([n for n in nodes if n["id"] != anchor])]


def document(*parts: list[str]) -> tuple[str, bool]:
    """The parts as one text within the cap, and whether it was cut."""
    text = "\n".join(line for part in parts for line in part if line)
    return text[:RESPONSE_CAP], len(text) > RESPONSE_CAP
