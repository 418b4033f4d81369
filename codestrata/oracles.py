"""The queries again as SQL (DuckDB's dialect), over the same tables."""

from __future__ import annotations

from .model import COMMENT_LINES, CONTAINMENT_KINDS, DISCOVERY_STOP_WORDS, FLOW_STOP_WORDS, FLOW_WORDS, IMPACT_WORDS, LOCATE_WORDS, REFERENCE_KINDS

NODES = """
nodes AS (
  SELECT r_regionkey::BIGINT AS node_seq, 'r:' || r_regionkey AS id, 'package' AS kind, r_name AS name, r_name || '.' || r_name AS qname, r_name AS path, TRUE AS exported FROM region
  UNION ALL SELECT 100000000000000000 + n_nationkey, 'n:' || n_nationkey, 'module', n_name, n_name || '.' || n_name, n_name, TRUE FROM nation
  UNION ALL SELECT 200000000000000000 + c_custkey, 'c:' || c_custkey, 'class', c_name, n_name || '.' || c_name, n_name, c_acctbal > 0 FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 300000000000000000 + s_suppkey, 's:' || s_suppkey, 'class', s_name, n_name || '.' || s_name, n_name, s_acctbal > 0 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 400000000000000000 + p_partkey, 'p:' || p_partkey, 'interface', p_name, p_brand || '.' || p_name, p_brand, TRUE FROM part
  UNION ALL SELECT 500000000000000000 + o_orderkey, 'o:' || o_orderkey, 'method', 'Order#' || o_orderkey, o_orderstatus || '.Order#' || o_orderkey, o_orderstatus, TRUE FROM orders
)"""
METHOD = "CASE l_returnflag WHEN 'A' THEN 'scope' WHEN 'N' THEN 'import' ELSE 'global_fallback' END"
EDGES = f"""
edges AS (
  SELECT n_nationkey::BIGINT AS edge_seq, 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst, 'owns' AS kind, NULL::VARCHAR AS method FROM nation
  UNION ALL SELECT 100000000000000000 + c_custkey, 'n:' || c_nationkey, 'c:' || c_custkey, 'owns', NULL FROM customer
  UNION ALL SELECT 200000000000000000 + s_suppkey, 'n:' || s_nationkey, 's:' || s_suppkey, 'owns', NULL FROM supplier
  UNION ALL SELECT 300000000000000000 + o_orderkey, 'c:' || o_custkey, 'o:' || o_orderkey, 'has_member', NULL FROM orders
  UNION ALL SELECT 400000000000000000 + ((l_orderkey::BIGINT * 16 + l_linenumber) * 262144 + l_partkey) * 16384 + l_suppkey, 'o:' || l_orderkey, 'p:' || l_partkey, 'call', {METHOD} FROM lineitem
  UNION ALL SELECT 500000000000000000 + ((l_orderkey::BIGINT * 16 + l_linenumber) * 262144 + l_partkey) * 16384 + l_suppkey, 'o:' || l_orderkey, 's:' || l_suppkey, 'type_use', {METHOD} FROM lineitem
)"""
G = f"WITH RECURSIVE {NODES}, {EDGES}"


def words(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


HOLDS, REFERS = f"kind IN ({words(CONTAINMENT_KINDS)})", f"kind IN ({words(REFERENCE_KINDS)})"


def hop(kind: str, ids: tuple[str, ...], incoming: bool) -> str:
    here, there = ("dst", "src") if incoming else ("src", "dst")
    return f"{G} SELECT {here} AS of_id, edge_seq, {there} AS id FROM edges WHERE kind = '{kind}' AND {here} IN ({words(ids)}) AND {there} IN (SELECT id FROM nodes)"


def levels(start: tuple[str, ...], depth: int, direction: str, where: str = "TRUE") -> str:
    """CTEs l0, l1, ...: what is reached first in each level; and `seen`."""
    out = {"outgoing": f"SELECT src AS a, dst AS b FROM edges WHERE {where}", "incoming": f"SELECT dst AS a, src AS b FROM edges WHERE {where}"}
    step = out.get(direction) or f"{out['outgoing']} UNION ALL {out['incoming']}"
    parts = [f"step AS ({step})", f"l0 AS (SELECT id, 0 AS distance FROM nodes WHERE id IN ({words(start)}))"]
    for d in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT id FROM l{k}" for k in range(d))
        parts.append(f"l{d} AS (SELECT DISTINCT b AS id, {d} AS distance FROM step JOIN l{d - 1} ON a = l{d - 1}.id WHERE b NOT IN ({before}) AND b IN (SELECT id FROM nodes))")
    parts.append("seen AS (" + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(depth + 1)) + ")")
    return ", ".join(parts)


def ranked(start: tuple[str, ...], depth: int, direction: str, where: str, most: int, per_file: int | None = None) -> str:
    """The same with caps: l0, l1, ... with the rank in which nodes are admitted."""
    out = {"outgoing": f"SELECT src AS a, dst AS b, 0 AS dir, edge_seq, kind FROM edges WHERE {where}", "incoming": f"SELECT dst AS a, src AS b, 1 AS dir, edge_seq, kind FROM edges WHERE {where}"}
    step = out.get(direction) or f"{out['outgoing']} UNION ALL {out['incoming']}"
    first = " UNION ALL ".join(f"SELECT '{s}' AS id, 0 AS distance, {k} AS rank, '' AS path" for k, s in enumerate(start))
    parts = [f"step AS ({step})", f"l0 AS ({first})"]
    for d in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT id, rank, path, distance FROM l{k}" for k in range(d))
        cap = f"n + coalesce((SELECT count(*) FROM s{d} WHERE distance > 0 AND s{d}.path = q.path), 0) <= {per_file}" if per_file and d >= 2 else "TRUE"
        parts += [
            f"s{d} AS ({before})",
            f"c{d} AS (SELECT b AS id, min((rank, dir, edge_seq)) AS r FROM step JOIN l{d - 1} ON a = l{d - 1}.id WHERE b NOT IN (SELECT id FROM s{d}) GROUP BY b)",
            f"q{d} AS (SELECT c{d}.id, r, path, row_number() OVER (PARTITION BY path ORDER BY r) AS n FROM c{d} JOIN nodes ON nodes.id = c{d}.id)",
            f"l{d} AS (SELECT id, {d} AS distance, (SELECT max(rank) FROM s{d}) + row_number() OVER (ORDER BY r) AS rank, path FROM q{d} q WHERE {cap} QUALIFY row_number() OVER (ORDER BY r) <= {most} - (SELECT count(*) FROM s{d}))",
        ]
    parts.append("seen AS (" + " UNION ALL ".join(f"SELECT id, distance, rank FROM l{k}" for k in range(depth + 1)) + ")")
    return ", ".join(parts)


def expansion(start: str, depth: int, kinds: tuple[str, ...], direction: str, most: int) -> str:
    return f"{G}, {ranked((start,), depth, direction, f'kind IN ({words(kinds)})' if kinds else 'TRUE', most)} SELECT id, distance::INT AS distance FROM seen"


def contains_count(text: str, values) -> str:
    return "(" + " + ".join(f"(contains({text}, '{w}'))::INT" for w in values) + ")"


SERVICES = "services AS (SELECT id, node_seq FROM nodes WHERE id LIKE 'c:%' AND exported)"
ASKED = "(['how does the ', 'what will break if I change ', 'where is ', ''])[(conv_id % 4 + 1)::INT] || coalesce(text, '')"
TOKENS = [w for w in "how does the Brand 1 part 17 work".split() if len(w) > 1 and w.lower() not in DISCOVERY_STOP_WORDS]


def token_points(t: str) -> str:
    t = t.lower()
    return f"(CASE WHEN lower(name) = '{t}' THEN 8.0 WHEN contains(lower(name), '{t}') THEN 4.0 ELSE 0 END + CASE WHEN lower(qname) = '{t}' THEN 6.0 WHEN contains(lower(qname), '{t}') THEN 3.0 ELSE 0 END + CASE WHEN contains(lower(path), '{t}') THEN 2.0 ELSE 0 END)"


def discover_sql() -> str:
    points = [token_points(t) for t in TOKENS]
    own = ", ".join(f"{p} AS p{i}" for i, p in enumerate(points))
    total, hits = " + ".join(f"p{i}" for i in range(len(points))), " + ".join(f"(p{i} > 0)::INT" for i in range(len(points)))
    together = " + ".join(f"max((p{i} > 0)::INT) OVER (PARTITION BY path)" for i in range(len(points)))
    return f"""{G}, scored AS (SELECT *, {own} FROM nodes WHERE kind = 'interface'), hit AS (SELECT *, ({total})::DOUBLE AS points, {hits} AS n FROM scored WHERE {total} > 0),
      joined AS (SELECT *, {together} AS co FROM hit),
      final AS (SELECT id, node_seq, round((points * CASE WHEN n >= 2 THEN 1 + 0.5 * (n - 1) ELSE 1 END + CASE WHEN co >= 2 THEN 8 * (co - 1) ELSE 0 END) * 1.4 + CASE WHEN length(name) <= 12 THEN 2 ELSE 0 END, 6) AS score FROM joined)
      SELECT id, score::DOUBLE AS score, row_number() OVER (ORDER BY score DESC, node_seq)::INT AS rank FROM final QUALIFY rank <= 25"""


ROLE = "CASE n_chars % 5 WHEN 0 THEN 100 WHEN 1 THEN 80 WHEN 2 THEN 70 WHEN 3 THEN 50 ELSE 20 END"
ROLE_LENGTH = "CASE n_chars % 5 WHEN 0 THEN 6 WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 15 ELSE 19 END"
BUDGET = f"""
WITH RECURSIVE d AS (SELECT source, doc_id AS seq, 'd:' || doc_id AS id, n_chars % 7 = 0 OR n_chars = 0 AS plain, {ROLE} AS priority, {ROLE_LENGTH} AS role_length, 40 + n_chars % 100 AS base, n_chars AS chars FROM documents),
g AS (SELECT source, sum(base) + sum(19 + length(id) + role_length) + 2 + greatest(count(*) - 1, 0) AS start FROM d GROUP BY source),
o AS (SELECT d.*, g.start, g.start > 32000 AS over_, row_number() OVER (PARTITION BY d.source ORDER BY CASE WHEN g.start > 32000 THEN priority ELSE -priority END, seq) AS n FROM d JOIN g USING (source)),
f AS (
  SELECT source, 0::BIGINT AS n, start::BIGINT AS used, ''::VARCHAR AS id, ''::VARCHAR AS level FROM g
  UNION ALL
  SELECT o.source, o.n, (f.used + CASE WHEN o.over_ THEN CASE WHEN f.used > 32000 THEN -o.base ELSE 0 END WHEN o.plain THEN 0 WHEN f.used + o.chars <= 32000 THEN o.chars WHEN f.used + least(800, o.chars) <= 32000 THEN least(800, o.chars) ELSE 0 END)::BIGINT, o.id,
    CASE WHEN o.over_ THEN CASE WHEN f.used > 32000 THEN 'OMIT' ELSE 'SIGNATURE' END WHEN o.plain THEN 'SIGNATURE' WHEN f.used + o.chars <= 32000 THEN 'FULL' WHEN f.used + least(800, o.chars) <= 32000 THEN 'SNIPPET' ELSE 'SIGNATURE' END
  FROM f JOIN o ON o.source = f.source AND o.n = f.n + 1
)
SELECT source, id, level FROM f WHERE n > 0"""

LINES = "doc_lines AS (SELECT doc_id, unnest(str_split_regex(coalesce(text, ''), '\\r?\\n')) AS t, generate_subscripts(str_split_regex(coalesce(text, ''), '\\r?\\n'), 1) - 1 AS line_no FROM documents)"

PLACES = {
    "reg": "SELECT r_regionkey AS k, 0 AS r, 'pkg/region_' || r_regionkey || '.py' AS p, '' AS v FROM region",
    "nat": "SELECT n_nationkey AS k, n_regionkey AS r, 'pkg/nation_' || n_nationkey || '.py' AS p, CASE WHEN n_nationkey % 2 = 0 THEN 'POST' ELSE 'PUT' END AS v FROM nation",
    "sup": "SELECT s_suppkey AS k, s_nationkey AS r, 'suppliers/s_' || s_suppkey || '.ts' AS p, '' AS v FROM supplier",
    "cus": "SELECT c_custkey AS k, 0 AS r, 'customers/Customer' || c_custkey || '.java' AS p, '' AS v FROM customer WHERE c_custkey % 10 = 0",
    "prt": "SELECT p_partkey AS k, 0 AS r, 'page_' || p_partkey || '.html' AS p, '' AS v FROM part WHERE p_partkey % 50 = 0",
    "ven": "SELECT 0 AS k, 0 AS r, 'vendor.ts' AS p, '' AS v", "too": "SELECT 0 AS k, 0 AS r, 'suppliers/tools.ts' AS p, '' AS v",
    "acc": "SELECT 0 AS k, 0 AS r, 'customers/Account.java' AS p, '' AS v", "bro": "SELECT 0 AS k, 0 AS r, 'pkg/broken.py' AS p, '' AS v",
    "one": "SELECT 0 AS k, min(r_regionkey) AS r, '' AS p, '' AS v FROM region",
}


def filled(value) -> str:
    """A value, or a text with a file's number {k}, its other number {r}, path {p} and word {v}, as SQL."""
    if not isinstance(value, str):
        return str(value)
    out = "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for x in "krpv":
        out = out.replace("{" + x + "}", f"' || {x} || '")
    return out


def listed(columns: str, rows: dict[str, list[tuple]]) -> str:
    """Rows for each file of a kind."""
    names = columns.split()
    return " UNION ALL ".join(f"SELECT {', '.join(f'{filled(v)} AS {n}' for n, v in zip(names, row, strict=True))} FROM ({PLACES[kind]})" for kind, own in rows.items() for row in own)


def member(owner: str, name: str) -> str:
    return "{p}::" + owner + "::" + name


FILE, R, N, S, C = "{p}::{p}", "Region{k}", "Nation{k}", "Supplier{k}Service", "Customer{k}"
DEFINED = {  # id, kind, qname, first and last line, exported, visibility
    "reg": [(FILE, "file", "{p}", 0, 17, True, "public"), ("{p}::routes", "variable", "routes", 2, 2, True, "public"), ("{p}::" + R, "class", R, 5, 12, True, "public"), (member(R, "__tablename__"), "variable", R + ".__tablename__", 6, 6, True, "public"), (member(R, "name"), "function", R + ".name", 8, 9, True, "public"), (member(R, "_hidden"), "function", R + "._hidden", 11, 12, False, "private"), ("{p}::shared", "function", "shared", 15, 16, True, "public")],
    "nat": [(FILE, "file", "{p}", 0, 21, True, "public"), ("{p}::" + N, "class", N, 5, 13, True, "public"), (member(N, "open"), "function", N + ".open", 6, 8, True, "public"), (member(N, "close"), "function", N + ".close", 12, 13, True, "public"), ("{p}::run_{k}", "function", "run_{k}", 17, 20, True, "public")],
    "sup": [(FILE, "file", "{p}", 0, 17, True, "public"), ("{p}::" + S, "class", S, 3, 14, True, "public"), (member(S, "rank"), "variable", S + ".rank", 4, 4, True, "private"), (member(S, "pay"), "method", S + ".pay", 6, 9, True, "public"), (member(S, "check"), "method", S + ".check", 11, 13, True, "public"), ("{p}::one", "variable", "one", 16, 16, False, "public")],
    "cus": [(FILE, "file", "{p}", 0, 7, True, "public"), ("{p}::" + C, "class", C, 2, 6, True, "public"), (member(C, "first"), "variable", C + ".first", 3, 3, True, "private"), (member(C, "move"), "method", C + ".move", 4, 4, True, "public"), (member(C, "hold"), "method", C + ".hold", 5, 5, True, "protected")],
    "prt": [(FILE, "file", "{p}", 0, 4, True, "public"), ("{p}::part-{k}", "variable", "part-{k}", 2, 2, True, "public")],
    "ven": [(FILE, "file", "{p}", 0, 3, True, "public"), ("{p}::Vendor", "interface", "Vendor", 0, 2, True, "public"), (member("Vendor", "rank"), "variable", "Vendor.rank", 1, 1, True, "public")],
    "too": [(FILE, "file", "{p}", 0, 3, True, "public"), ("{p}::helper", "function", "helper", 0, 2, True, "public")],
    "acc": [(FILE, "file", "{p}", 0, 4, True, "public"), ("{p}::Account", "class", "Account", 1, 3, True, "public"), (member("Account", "close"), "method", "Account.close", 2, 2, True, "public")],
    "bro": [(FILE, "file", "{p}", 0, 8, True, "public"), ("{p}::before", "function", "before", 0, 1, True, "public"), ("{p}::after", "function", "after", 6, 7, True, "public")],
}
REFERRED = {  # from, kind, name, line, path of an import
    "reg": [(FILE, "import", "Blueprint", 0, "flask"), (FILE, "call", "Blueprint", 2, ""), ("{p}::" + R, "inherit", "Base", 5, ""), (member(R, "_hidden"), "call", "shared", 12, "")],
    "nat": [(FILE, "import", "json", 0, "json"), *((FILE, "import", n, line, "pkg/region_{r}") for n, line in (("Region{r}", 1), ("routes", 1), ("common", 2))), (FILE, "call", "routes.route", 16, ""), ("{p}::" + N, "inherit", "Region{r}", 5, ""), (member(N, "open"), "call", "self.close", 7, ""), (member(N, "open"), "call", "common", 8, ""), (member(N, "close"), "call", "print", 13, ""), (member(N, "close"), "call", "json.dumps", 13, ""), *(("{p}::run_{k}", "call", n, line, "") for n, line in ((N, 18), ("it.open", 19), ("missing_{k}", 20)))],
    "sup": [(FILE, "import", "Vendor", 0, "../vendor"), (FILE, "import", "assist", 1, "./tools.js"), (FILE, "instantiate", S, 16, ""), ("{p}::" + S, "implement", "Vendor", 3, ""), (member(S, "pay"), "type_use", "Vendor", 6, ""), (member(S, "pay"), "call", "this.check", 7, ""), (member(S, "pay"), "call", "assist", 8, ""), (member(S, "check"), "call", "lost{k}", 12, "")],
    "cus": [(FILE, "import", "customers.Account", 1, "customers.Account"), ("{p}::" + C, "inherit", "Account", 2, ""), (member(C, "move"), "call", "hold", 4, "")],
    "prt": [(FILE, "import", "suppliers/tools.js", 1, "suppliers/tools.js"), (FILE, "import", "style.css", 1, "style.css")],
    "bro": [("{p}::after", "call", "before", 7, "")],
}
SCOPED = {  # owner, kind, kind of the parent (of a local name: its type)
    "reg": [(FILE, "global", ""), ("{p}::" + R, "class", "global"), (member(R, "name"), "function", "class"), (member(R, "_hidden"), "function", "class"), ("{p}::shared", "function", "global")],
    "nat": [(FILE, "global", ""), ("{p}::" + N, "class", "global"), (member(N, "open"), "function", "class"), (member(N, "close"), "function", "class"), ("{p}::run_{k}", "function", "global"), ("{p}::run_{k}", "local", N)],
    "sup": [(FILE, "global", ""), ("{p}::" + S, "class", "global"), (member(S, "pay"), "function", "class"), (member(S, "check"), "function", "class")],
    "cus": [(FILE, "global", ""), ("{p}::" + C, "class", "global"), (member(C, "move"), "function", "class"), (member(C, "hold"), "function", "class")],
    "prt": [(FILE, "global", "")], "ven": [(FILE, "global", ""), ("{p}::Vendor", "class", "global")], "too": [(FILE, "global", ""), ("{p}::helper", "function", "global")],
    "acc": [(FILE, "global", ""), ("{p}::Account", "class", "global"), (member("Account", "close"), "function", "class")], "bro": [(FILE, "global", ""), ("{p}::before", "function", "global"), ("{p}::after", "function", "global")],
}
RESOLVED = {  # from, to, kind, how
    "reg": [(FILE, "external::flask::Blueprint", "import", "import"), (FILE, "external::flask::Blueprint", "call", "import"), (member(R, "_hidden"), "{p}::shared", "call", "scope")],
    "nat": [(FILE, "external::json::json", "import", "import"), *((FILE, "pkg/region_{r}.py::" + n, "import", "import") for n in ("Region{r}", "routes", "shared")), ("{p}::" + N, "pkg/region_{r}.py::Region{r}", "inherit", "import"), (member(N, "open"), member(N, "close"), "call", "scope"), (member(N, "open"), "pkg/region_{r}.py::shared", "call", "import"), (member(N, "close"), "external::builtin::print", "call", "global_fallback"), (member(N, "close"), "external::json::json::dumps", "call", "import"), ("{p}::run_{k}", "{p}::" + N, "call", "scope"), ("{p}::run_{k}", member(N, "open"), "call", "scope")],
    "sup": [(FILE, "vendor.ts::Vendor", "import", "import"), (FILE, "suppliers/tools.ts::helper", "import", "import"), (FILE, "{p}::" + S, "instantiate", "scope"), ("{p}::" + S, "vendor.ts::Vendor", "implement", "import"), (member(S, "pay"), "vendor.ts::Vendor", "type_use", "import"), (member(S, "pay"), member(S, "check"), "call", "scope"), (member(S, "pay"), "suppliers/tools.ts::helper", "call", "import")],
    "cus": [("{p}::" + C, "customers/Account.java::Account", "inherit", "global_fallback"), (member(C, "move"), member(C, "hold"), "call", "scope")],
    "prt": [(FILE, "suppliers/tools.ts::suppliers/tools.ts", "import", "import"), (FILE, "external::style.css::style.css", "import", "import")],
    "bro": [("{p}::after", "{p}::before", "call", "scope")],
}
#: The call of a decorator's `routes.route`, which no import leads to: the first `routes` anywhere.
ROUTES = f"SELECT 'pkg/nation_' || n_nationkey || '.py::pkg/nation_' || n_nationkey || '.py' AS from_id, {filled('pkg/region_{r}.py::routes')} AS to_id, 'call' AS kind, 'global_fallback' AS method FROM nation, ({PLACES['one']})"
RESOLVED_SQL = f"{listed('from_id to_id kind method', RESOLVED)} UNION ALL {ROUTES}"
OUTSIDE = {"one": [("external::builtin::print", "function", "print", ""), ("external::flask::Blueprint", "class", "flask.Blueprint", ""), ("external::json::json", "variable", "json.json", ""), ("external::json::json::dumps", "method", "json.json.dumps", "external::json::json"), ("external::style.css::style.css", "variable", "style.css.style.css", "")]}
MEMBERS = {  # id, source, comment
    "reg": [(member(R, "name"), "    def name(self):\n        return 'region'", ""), (member(R, "_hidden"), "    def _hidden(self):\n        return shared({k})", "")],
    "nat": [(member(N, "open"), "    def open(self):\n        self.close()\n        return common(1)", ""), (member(N, "close"), "    def close(self):\n        print(json.dumps(1))", "# closes\n# for good")],
    "sup": [(member(S, "pay"), "  pay(to: Vendor): void {\n    this.check();\n    assist({r});\n  }", ""), (member(S, "check"), "  check(): boolean {\n    return /[{(]/.test(`${lost{k}()}`);\n  }", "")],
    "cus": [(member(C, "move"), "  public void move(int n) { hold(n); }", ""), (member(C, "hold"), "  protected void hold(int n) { }", "")],
    "acc": [(member("Account", "close"), "  public void close() { }", "")],
}
SPANS = {"reg": [("{p}", 2, 16, 6)], "nat": [("{p}", 5, 20, 4)], "sup": [("{p}", 3, 16, 5)], "cus": [("{p}", 2, 6, 4)], "prt": [("{p}", 2, 2, 1)], "ven": [("{p}", 0, 2, 2)], "too": [("{p}", 0, 2, 1)], "acc": [("{p}", 1, 3, 2)], "bro": [("{p}", 0, 7, 2)]}
LOST = "Reference ''{}'' could not be resolved".replace("''", "'")
TOLD = {  # kind, severity, message, path, line
    "bro": [("parse_error", "error", "Syntax error at line 4", "{p}", 3)],
    "reg": [("unresolved_reference", "info", LOST.format("Base"), "{p}", 5)],
    "nat": [("unresolved_reference", "info", LOST.format("missing_{{k}}").replace("{{k}}", "{k}"), "{p}", 20)],
    "sup": [("unresolved_reference", "info", LOST.format("lost{{k}}").replace("{{k}}", "{k}"), "{p}", 12)],
    "cus": [("unresolved_import", "warning", "Unable to resolve import path or name for 'customers.Account' in customers.Account", "{p}", 1)],
}
TARGETS = {"nat": [("{p}", n, "pkg/region_{r}.py") for n in ("Region{r}", "routes", "common")], "sup": [("{p}", "Vendor", "vendor.ts")], "cus": [("{p}", "customers.Account", "customers/Account.java")], "prt": [("{p}", "suppliers/tools.js", "suppliers/tools.ts")]}

ORACLES = {
    "source_symbols": listed("id kind qname sl el exported visibility", DEFINED),
    "source_references": listed("from_id kind raw_name sl import_path", REFERRED),
    "source_scopes": listed("owner_symbol_id kind parent", SCOPED),
    "framework_tags": listed("id api_method api_path table_name is_service", {"reg": [("{p}::" + R, "", "", "region_{k}", False)], "nat": [("{p}::run_{k}", "{v}", "/nation/{k}", "", False)], "sup": [("{p}::" + S, "", "", "", True)]}),
    "import_targets": listed("path raw_name file", TARGETS),
    "resolved_references": RESOLVED_SQL,
    "project_diagnostics": listed("kind severity message path sl", TOLD),
    "outside_names": listed("id kind qname parent_id", OUTSIDE),
    "project_graph": f"""WITH s AS ({listed("id kind qname sl el exported visibility", DEFINED)}), o AS ({listed("id kind qname parent_id", OUTSIDE)}), e AS ({RESOLVED_SQL}),
      nodes AS (SELECT kind FROM s UNION ALL SELECT 'project'),
      -- a member stands behind its owner's id; files belong to the project
      edges AS (SELECT CASE WHEN kind = 'method' THEN 'has_member' ELSE 'owns' END AS kind, '' AS method FROM s WHERE kind = 'file' OR id LIKE '%::%::%' UNION ALL SELECT 'has_member', '' FROM o WHERE parent_id <> '' UNION ALL SELECT kind, method FROM e)
      SELECT 'node' AS what, kind, '' AS method, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', kind, method, count(*) FROM edges GROUP BY kind, method""",
    "project_slices": f"WITH m AS ({listed('id source comment', MEMBERS)}) SELECT id, sha256(source) AS source_sha, trim(str_split(source, chr(10))[1]) AS signature, comment FROM m",
    "answer_relations": f"""WITH n AS (SELECT n_regionkey AS r FROM nation WHERE n_nationkey = 3), x AS (SELECT 'run_3 (pkg/nation_3.py:18)' AS run, 'Nation3 (pkg/nation_3.py:6)' AS own, 'Nation3.open (pkg/nation_3.py:7)' AS open, 'Nation3.close (pkg/nation_3.py:13)' AS close, {filled("Region{r} (pkg/region_{r}.py:6)")} AS base, {filled("shared (pkg/region_{r}.py:16)")} AS shared FROM n)
      SELECT unnest([run || ' calls ' || own, run || ' calls ' || open, own || ' owns ' || open, own || ' owns ' || close, own || ' extends ' || base, open || ' calls ' || close, open || ' calls ' || shared, 'Resolution confidence: 5 high, 0 low']) AS line FROM x""",
    "symbol_spans": f"SELECT path, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, n::BIGINT AS n FROM ({listed('path start_line end_line n', SPANS)})",
    "graph_stats": f"{G} SELECT 'edge_kind' AS what, kind, count(*) AS n FROM edges GROUP BY kind UNION ALL SELECT 'edges', '', count(*) FROM edges UNION ALL SELECT 'nodes', '', count(*) FROM nodes",
    "callers_of": hop("call", ("p:1", "p:7", "p:11"), True),
    "callees_of": hop("call", ("o:1", "o:2", "o:33"), False),
    "members_of": hop("has_member", ("c:1", "c:4", "c:10"), False),
    "imports_of": hop("type_use", ("o:1", "o:2", "o:33"), False),
    "find_by_name": f"{G} SELECT id, kind, qname FROM nodes WHERE name = 'NATION_3'",
    "region_both_d2": f"{G}, {levels(('c:1',), 2, 'both')} SELECT id, distance::INT AS distance FROM seen",
    "region_out_d3": f"{G}, {levels(('n:3', 'c:1'), 3, 'outgoing')} SELECT id, distance::INT AS distance FROM seen",
    "region_kind_filter": f"{G}, {levels(('c:1', 'c:4'), 3, 'both', "kind IN ('call', 'has_member')")} SELECT DISTINCT src, dst, kind FROM edges JOIN seen x ON src = x.id JOIN seen y ON dst = y.id WHERE kind IN ('call', 'has_member') AND least(x.distance, y.distance) < 3",
    "region_capped": f"{G}, {ranked(('c:1',), 2, 'both', 'TRUE', 60, 10)} SELECT id, distance::INT AS distance FROM seen",
    "region_edge_topk": f"""{G}, {ranked(('c:1',), 2, 'outgoing', 'TRUE', 200)}, e AS (SELECT src, dst, kind, min((x.rank, 0, edge_seq)) AS place, min(CASE WHEN x.distance = 0 OR y.distance = 0 THEN 0 ELSE greatest(x.distance, y.distance) END) AS priority FROM edges JOIN seen x ON src = x.id JOIN seen y ON dst = y.id WHERE x.distance < 2 GROUP BY src, dst, kind)
      SELECT src, dst, kind, row_number() OVER (ORDER BY priority, place)::INT AS edge_rank, greatest((SELECT count(*) FROM e) - 15, 0)::BIGINT AS omitted FROM e QUALIFY edge_rank <= 15""",
    "shortest_paths": f"""{G}, p AS (SELECT 'r:1' AS here, ['r:1'] AS path, []::VARCHAR[] AS kinds, []::BIGINT[] AS seqs UNION ALL SELECT dst, list_append(path, dst), list_append(kinds, kind), list_append(seqs, edge_seq) FROM p JOIN edges ON src = here WHERE len(path) <= 6 AND here <> 'p:1'),
      hit AS (SELECT * FROM p WHERE here = 'p:1') SELECT row_number() OVER (ORDER BY seqs)::INT AS path_rank, array_to_string(path, '>') AS path, array_to_string(kinds, '>') AS kinds FROM hit WHERE len(path) = (SELECT min(len(path)) FROM hit) QUALIFY path_rank <= 10""",
    "impact_cone": f"{G}, {levels(('p:1',), 3, 'incoming', REFERS)} SELECT id, distance::INT AS distance, CASE distance WHEN 0 THEN '' ELSE 'call' END AS via FROM seen",
    "expand_locate": expansion("c:1", 1, ("import", "inherit", "implement", *CONTAINMENT_KINDS), "both", 50),
    "expand_flow": expansion("o:1", 3, ("call", "instantiate"), "both", 70),
    "expand_impact": expansion("s:1", 3, (), "incoming", 60),
    "ancestor_chain": f"{G}, up AS (SELECT dst, min_by(src, edge_seq) AS src FROM edges WHERE kind IN ('owns', 'has_member') GROUP BY dst), walk AS (SELECT id AS of_id, 0 AS depth, id FROM nodes WHERE kind = 'class' UNION ALL SELECT of_id, depth + 1, src FROM walk JOIN up ON dst = id) SELECT of_id, depth::INT AS depth, id FROM walk WHERE depth > 0",
    "neighborhood": f"{G}, {levels(('o:1',), 2, 'both')} SELECT 'node' AS what, kind, count(*) AS n FROM nodes JOIN seen USING (id) GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM (SELECT src, dst, kind FROM edges WHERE src IN (SELECT id FROM seen WHERE distance < 2) UNION SELECT src, dst, kind FROM edges WHERE dst IN (SELECT id FROM seen WHERE distance < 2)) GROUP BY kind",
    "flow_between": f"{G}, first AS (SELECT dst FROM edges WHERE src = 'o:1' AND kind = 'call' ORDER BY edge_seq LIMIT 2) SELECT DISTINCT 'o:1>' || dst AS path, 'call' AS kinds FROM first",
    "blast_radius": f"""{G}, inc AS (SELECT dst, n.path AS file, edge_seq FROM edges LEFT JOIN nodes n ON n.id = src WHERE edges.{REFERS} AND dst LIKE 'p:%'),
      byf AS (SELECT dst, file, count(*) AS n, min(edge_seq) AS first FROM inc GROUP BY dst, file), t AS (SELECT dst, sum(n) AS refs, count(file) AS files, array_to_string((list(file ORDER BY first))[1:3], ', ') AS shown FROM byf GROUP BY dst)
      SELECT id, coalesce(refs, 0)::BIGINT AS "references", coalesce(files, 0)::BIGINT AS n_files, coalesce(shown, '') || CASE WHEN files > 3 THEN ' +' || (files - 3) || ' more' ELSE '' END AS files FROM nodes LEFT JOIN t ON dst = id WHERE kind = 'interface'""",
    "test_coverage": f"""{G}, hit AS (SELECT DISTINCT dst FROM edges JOIN nodes ON src = id WHERE method IS NOT NULL AND path = 'F')
      SELECT kind, CASE WHEN kind IN ('function', 'method', 'class', 'interface') THEN id IN (SELECT dst FROM hit) END AS state, count(*) AS n FROM nodes GROUP BY ALL""",
    "discover_parts": discover_sql(),
    # 15 points for the route, 1.4 times for a definition, 2 more for a short name
    "endpoint_search": "SELECT 'o:' || o_orderkey AS id, (15 * 1.4 + 2)::DOUBLE AS score, row_number() OVER (ORDER BY o_orderkey)::INT AS rank FROM orders WHERE o_orderkey = 17",
    "anchors_of_specs": f"{G} SELECT 'resolved' AS status, 'id' AS what, id AS value FROM nodes WHERE name IN ('NATION_3', 'Order#1') UNION ALL SELECT 'resolved', 'missing', unnest(['zzzz', 'qqqq'])",
    "anchor_exact": f"{G} SELECT id, 'resolved' AS status, 1 AS rank FROM nodes WHERE lower(qname) = 'nation_3.nation_3'",
    "anchor_ambiguous": f"{G} SELECT id, 'ambiguous' AS status, row_number() OVER (ORDER BY NOT exported, length(qname), node_seq)::INT AS rank FROM nodes WHERE id LIKE 'c:%' QUALIFY rank <= 10",
    "plan_strategy": f"""WITH q AS (SELECT conv_id, turn, lower({ASKED}) AS q FROM conversations), c AS (SELECT conv_id, turn, {contains_count('q', LOCATE_WORDS)} AS l, {contains_count('q', FLOW_WORDS)} AS f, {contains_count('q', IMPACT_WORDS)} AS i FROM q)
      SELECT conv_id, turn, CASE WHEN i > l AND i > f THEN 'impact' WHEN f > l THEN 'flow' ELSE 'locate' END AS strategy FROM c""",
    "flow_terms": f"""WITH w AS (SELECT conv_id, turn, list_transform(regexp_split_to_array(trim(coalesce(text, '')), '\\s+'), lambda x: regexp_replace(regexp_replace(x, '^["''(]+', ''), '[?!,;:()"'']+$', '')) AS w FROM conversations)
      SELECT conv_id, turn, array_to_string(list_filter(w, lambda x: length(x) > 1 AND (regexp_matches(x, '[A-Z]') OR regexp_matches(x, '[._/]') OR (regexp_full_match(x, '[a-z]+') AND x NOT IN ({words(FLOW_STOP_WORDS)}))))[1:8], ' ') AS terms FROM w""",
    "span_merge": """WITH s AS (SELECT user_id, hour(ts) * 60 + minute(ts) AS a, hour(ts) * 60 + minute(ts) + 2 AS b FROM events), m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
      k AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS span FROM m)
      SELECT user_id, span::BIGINT AS span, min(a)::BIGINT AS start_line, max(b)::BIGINT AS end_line, count(*) AS n FROM k GROUP BY user_id, span""",
    "budget_alloc": BUDGET,
    "confidence_summary": f"{G} SELECT kind, count(*) FILTER (method = 'global_fallback') AS low, count(*) FILTER (method <> 'global_fallback') AS high FROM edges WHERE method IS NOT NULL GROUP BY kind",
    "innermost_scope": """WITH s AS (SELECT o_orderkey AS k, o_custkey AS c, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS a, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) + trunc(o_totalprice / 1000)::INT AS b FROM orders)
      SELECT x.k::VARCHAR AS id, min_by(y.k, (y.b - y.a, y.k))::VARCHAR AS scope_id FROM s x JOIN s y ON x.c = y.c AND x.k <> y.k AND y.a <= x.a AND x.a <= y.b GROUP BY x.k""",
    "name_resolution": """WITH w AS (SELECT o_orderkey AS ref_seq, c_nationkey AS nation, o_orderkey % 130 AS name FROM orders JOIN customer ON o_custkey = c_custkey), s AS (SELECT s_suppkey, s_suppkey % 128 AS name, s_nationkey AS nation FROM supplier),
      a AS (SELECT ref_seq, min(s_suppkey) AS t FROM w JOIN s USING (name, nation) GROUP BY ref_seq), b AS (SELECT ref_seq, min(s_suppkey) AS t FROM w JOIN s USING (name) GROUP BY ref_seq)
      SELECT ref_seq, coalesce(a.t, b.t) AS target, CASE WHEN a.t IS NOT NULL THEN 'scope' WHEN b.t IS NOT NULL THEN 'global_fallback' ELSE 'unresolved' END AS method FROM w LEFT JOIN a USING (ref_seq) LEFT JOIN b USING (ref_seq)""",
    "module_deps": f"{G} SELECT DISTINCT x.path AS src_path, y.path AS dst_path FROM edges JOIN nodes x ON src = x.id JOIN nodes y ON dst = y.id WHERE edges.{REFERS} AND x.path <> y.path",
    "service_deps": f"{G}, {SERVICES} SELECT DISTINCT 'c:' || o_custkey AS src, 'c:' || (o_custkey + 1) AS dst FROM orders WHERE 'c:' || o_custkey IN (SELECT id FROM services) AND 'c:' || (o_custkey + 1) IN (SELECT id FROM services)",
    "data_access": f"{G}, {SERVICES} SELECT DISTINCT CASE WHEN 'c:' || o_custkey IN (SELECT id FROM services) THEN 'c:' || o_custkey ELSE 'o:' || o_orderkey END AS src, 's:' || l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "api_routes": "SELECT 'api:GET:' || regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS route, 'page:' || page_id AS handler FROM pages",
    "trace_flow": f"{G} SELECT DISTINCT 1 AS depth, 'c:1' AS src, dst FROM edges WHERE {REFERS} AND src IN (SELECT dst FROM edges WHERE src = 'c:1' AND kind = 'has_member')",
    "flat_view": f"{G} SELECT kind, count(*) AS n FROM (SELECT DISTINCT src, dst, CASE WHEN {HOLDS} THEN 'contains' ELSE kind END AS kind FROM edges WHERE {HOLDS} OR src <> dst) GROUP BY kind",
    "kind_counts": f"{G} SELECT kind, count(*) AS n FROM nodes WHERE kind <> 'project' GROUP BY kind",
    "one_hop_ids": f"{G} SELECT 'o:1' AS id UNION SELECT dst FROM edges WHERE src = 'o:1' UNION SELECT src FROM edges WHERE dst = 'o:1'",
    "visible_nodes": f"{G}, hit AS (SELECT id FROM nodes WHERE kind = 'class' AND (contains(lower(name), 'customer#00000001') OR contains(lower(qname), 'customer#00000001')) UNION SELECT src FROM hit JOIN edges ON dst = id WHERE edges.{HOLDS}) SELECT id FROM hit",
    "incremental_update": """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS path FROM orders), kept AS (SELECT * FROM o WHERE path <> 'P'), new AS (SELECT k, 'P' AS path FROM o WHERE k % 2 = 0 AND k NOT IN (SELECT k FROM kept))
      SELECT path, count(*) AS n FROM (SELECT * FROM kept UNION ALL SELECT * FROM new) GROUP BY path""",
    "debounce_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
      SELECT user_id, min(ts) AS session_start, max(ts) AS last_change, count(*) AS n FROM s GROUP BY user_id, s""",
    "callsite_search": f"WITH {LINES}, w AS (SELECT doc_id, regexp_extract(coalesce(text, ''), '([A-Za-z]+)', 1) AS name FROM documents) SELECT doc_id, min(line_no)::INT AS line_no FROM doc_lines JOIN w USING (doc_id) WHERE line_no >= 1 AND length(name) > 0 AND regexp_matches(t, '\\b' || name || '\\b') AND NOT regexp_matches(t, '\\b(def|function)\\s+' || name || '\\b') AND NOT regexp_matches(t, '\\bclass\\s+' || name || '\\b') AND NOT regexp_matches(t, '(?i)\\b' || name || '\\s*:\\s*(Callable|str|int|float|bool|list|dict|tuple|set|Any|Optional|Union)\\b') GROUP BY doc_id",
    "doc_comment": f"""WITH {LINES}, w AS (SELECT doc_id, max(line_no) AS last FROM doc_lines GROUP BY doc_id),
      above AS (SELECT l.doc_id, l.line_no, regexp_replace(CASE WHEN l.line_no % 2 = 0 THEN '# ' || t ELSE t END, '^\\s+|\\s+$', '', 'g') AS t FROM doc_lines l JOIN w ON l.doc_id = w.doc_id AND l.line_no < w.last),
      bottom AS (SELECT doc_id, max(line_no) AS b FROM above WHERE t <> '' GROUP BY doc_id),
      stop AS (SELECT doc_id, max(line_no) AS s FROM above JOIN bottom USING (doc_id) WHERE line_no <= b AND NOT (starts_with(t, '#') OR starts_with(t, '//')) GROUP BY doc_id),
      kept AS (SELECT doc_id, line_no, t FROM above JOIN bottom USING (doc_id) LEFT JOIN stop USING (doc_id) WHERE line_no <= b AND line_no > coalesce(s, -1) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) <= {COMMENT_LINES})
      SELECT doc_id, sha256(coalesce((SELECT string_agg(t, chr(10) ORDER BY line_no) FROM kept WHERE kept.doc_id = w.doc_id), '')) AS comment_sha FROM w""",
    "html_refs": """WITH h AS (SELECT page_id, '<div id="top-' || page_id || '"></div><script src="/js/' || page_id % 7 || '.js"></script><link rel="x" href="/c/' || page_id % 3 || '.css">' || coalesce(html, '') AS html FROM pages)
      SELECT page_id::BIGINT AS page_id, tag, unnest(found) AS name FROM (SELECT page_id, 'id' AS tag, regexp_extract_all(html, '<[a-zA-Z][^<>]*?\\sid="([^"]+)"', 1) AS found FROM h UNION ALL SELECT page_id, 'import', regexp_extract_all(html, '<script[^<>]*?\\ssrc="([^"]+)"', 1) FROM h UNION ALL SELECT page_id, 'import', regexp_extract_all(html, '<link[^<>]*?\\shref="([^"]+)"', 1) FROM h)""",
    "token_estimate": "SELECT doc_id, ceil(length(coalesce(text, '')) / 4.0)::BIGINT AS tokens FROM documents",
    "scan_filter": """WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages) SELECT page_id, len(list_filter(str_split(path, '/'), lambda x: lower(x) IN ('node_modules', 'dist', 'build', '__pycache__', '.git', 'venv', '.venv', 'env', '.env') OR starts_with(x, '.'))) > 0 AS skipped,
      CASE regexp_extract(lower(path), '\\.[^./]*$') WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'tsx' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'jsx' WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' WHEN '.html' THEN 'html' ELSE '' END AS lang FROM p""",
}
