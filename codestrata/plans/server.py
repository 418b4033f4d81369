"""A line protocol for the engine: one JSON-RPC message a line."""

from __future__ import annotations

import json
import sys

from . import plan as plans
from .engine import Engine

TOOLS = {
    "search_symbols": lambda e, a: plans.search_symbols(a["query"], a.get("kind"), bool(a.get("expand")), a.get("depth")),
    "explore_region": lambda e, a: plans.explore_region(a["anchors"], a.get("direction", "outgoing"), a.get("depth", 3), a.get("edgeKinds", ())),
    "trace_path": lambda e, a: plans.trace_path(a["from"], a["to"], a.get("depth", 6), a.get("edgeKinds", ())),
    "analyze_impact": lambda e, a: plans.analyze_impact(a["anchor"], a.get("depth", 3)),
    "explore_flow": lambda e, a: plans.explore_flow(e.graph.nodes.sparkSession, a["query"], a.get("depth", 1)),
    "query_graph": lambda e, a: plans.from_dict(a["plan"]),
}


def handle(engine: Engine, line: str) -> dict | None:
    try:
        message = json.loads(line)
    except ValueError:
        return _error(None, -32700, "parse error")
    if not isinstance(message, dict) or "method" not in message:
        return _error(message.get("id") if isinstance(message, dict) else None, -32600, "invalid request")
    id_, method, args = message.get("id"), message["method"], message.get("params") or {}
    if method == "initialize":
        return _result(id_, {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "codestrata", "version": "1"}})
    if method == "tools/list":
        return _result(id_, {"tools": [{"name": n} for n in TOOLS]})
    if method == "tools/call":
        name = args.get("name")
        if name not in TOOLS:
            return _error(id_, -32602, f"no tool {name}")
        try:
            plan = TOOLS[name](engine, args.get("arguments") or {})
        except (KeyError, TypeError) as e:
            return _error(id_, -32602, f"bad arguments: {e}")
        answer = engine.answer(plan)
        if answer["status"] == "invalid":
            return _error(id_, -32602, "; ".join(answer["errors"]))
        return _result(id_, {"content": [{"type": "text", "text": json.dumps(answer, default=str)}]})
    if id_ is None:
        return None  # a notification
    return _error(id_, -32601, f"no method {method}")


def _result(id_, result) -> dict:
    return {"jsonrpc": "2.0", "id": id_, "result": result}


def _error(id_, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}}


def serve(engine: Engine, lines=sys.stdin, out=sys.stdout) -> None:
    for line in lines:
        if line.strip() and (answer := handle(engine, line)) is not None:
            print(json.dumps(answer), file=out, flush=True)
