"""Operators on rows built by hand."""

import random

from codestrata.operators import budget, evidence, graph, indexes, merge, search, traverse, views
from codestrata.sources import scan, store
from codestrata.streaming import watch

NODES = "node_seq long, id string, kind string, name string, qname string, path string, sl int, el int, exported boolean, is_service boolean, api_method string, api_path string, test_covered boolean"


def shop(spark):
    rows = [
        (0, "project", "project", "shop", "shop", "", 0, 0),
        (1, "src/bill.ts::src/bill.ts", "file", "src/bill.ts", "src/bill.ts", "src/bill.ts", 0, 20),
        (2, "src/bill.ts::BillingService", "class", "BillingService", "BillingService", "src/bill.ts", 1, 12),
        (3, "src/bill.ts::BillingService::settle", "method", "settle", "BillingService.settle", "src/bill.ts", 2, 5),
        (4, "src/bill.ts::BillingService::revert", "method", "revert", "BillingService.revert", "src/bill.ts", 6, 9),
        (5, "src/out.ts::OrderController", "class", "OrderController", "OrderController", "src/out.ts", 0, 9),
        (6, "src/out.ts::OrderController::placeOrder", "method", "placeOrder", "OrderController.placeOrder", "src/out.ts", 2, 6),
    ]
    nodes = spark.createDataFrame([(*r, True, r[3] == "BillingService", None, None, False) for r in rows], NODES)
    ids = [r[1] for r in rows]
    links = [("owns", 0, 1, None), ("owns", 1, 2, None), ("has_member", 2, 3, None), ("has_member", 2, 4, None), ("has_member", 5, 6, None), ("import", 5, 2, "import"), ("call", 6, 3, "scope"), ("call", 6, 3, "global_fallback")]
    edges = spark.createDataFrame([(n, ids[a], ids[b], k, m) for n, (k, a, b, m) in enumerate(links)] + [(99, ids[6], "external::x", "call", "scope")], "edge_seq long, src string, dst string, kind string, method string")
    return nodes, edges, ids


def start(spark, *ids):
    return spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id string, rank long")


def test_traversals(spark):
    nodes, edges, ids = shop(spark)
    found, kept, left = traverse.region(nodes, edges, start(spark, ids[6]), "outgoing", (), 2, 100, 1, 30)
    assert {r.id for r in found.collect()} == {ids[6], ids[3]} and kept.count() == 1 and left == 0
    both, _, _ = traverse.region(nodes, edges, start(spark, ids[3]), "both", (), 2, 4, 120, 30)
    assert {r.id: r.distance for r in both.collect()} == {ids[3]: 0, ids[2]: 1, ids[6]: 1, ids[4]: 2}
    way = traverse.paths(edges, ids[6], ids[3], (), 3, 10).collect()
    assert len(way) == 2 and all(r.path == [ids[6], ids[3]] for r in way)
    assert traverse.paths(edges, ids[3], ids[3]).count() == 1 and traverse.paths(edges, ids[3], ids[6]).count() == 0
    cone, links = traverse.impact(nodes, edges, start(spark, ids[3]))
    assert {r.id: r.via for r in cone.collect()} == {ids[3]: None, ids[6]: "call"} and links.count() == 1
    assert graph.callees_of(nodes, edges, start(spark, ids[6])).count() == 2
    blast = traverse.blast_radius(nodes, edges, start(spark, ids[3], ids[4])).collect()
    assert {r.id: (r.references, r.n_files, r.files, r.no_tests) for r in blast} == {ids[3]: (2, 1, "src/out.ts", True), ids[4]: (0, 0, "", True)}


def plain_paths(links, a, b, most_depth):
    """All shortest paths with the places of their edges, in breadth-first order."""
    level, seen = [((a,), ())], {a}
    for _ in range(most_depth):
        level = [((*p, d), (*q, n)) for p, q in level for n, (s, d) in enumerate(links) if s == p[-1] and d not in seen]
        if done := sorted((q, p) for p, q in level if p[-1] == b):
            return done
        seen |= {p[-1] for p, _ in level}
    return []


def test_paths_and_ties(spark):
    """Shortest paths in random graphs with parallel edges, cycles and hubs; results don't depend on the order of rows where edges share a number."""
    rng = random.Random(6)
    for _ in range(6):
        links = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(22)]
        edges = spark.createDataFrame([(i, s, d, "call", None) for i, (s, d) in enumerate(links)], "edge_seq long, src string, dst string, kind string, method string")
        a, b, depth = "n0", f"n{rng.randrange(1, 9)}", rng.randint(1, 5)
        want = plain_paths(links, a, b, depth)[:3]
        got = traverse.paths(edges, a, b, (), depth, 3).orderBy("path_rank").collect()
        assert [r.path for r in got] == [list(p) for _, p in want]
    rows = [(0, "a", x, "call", None) for x in "bcdef"]
    nodes = spark.createDataFrame([(i, x, "class", x, x, "p") for i, x in enumerate("abcdef")], "node_seq long, id string, kind string, name string, qname string, path string")
    kept = set()
    for _ in range(3):
        rng.shuffle(rows)
        edges = spark.createDataFrame(rows, "edge_seq long, src string, dst string, kind string, method string").repartition(3)
        found, links, left = traverse.region(nodes, edges, start(spark, "a"), "outgoing", (), 1, 4, 2)
        kept.add((tuple(sorted(r.id for r in found.collect())), tuple(sorted(r.dst for r in links.collect())), left))
    assert kept == {(("a", "b", "c", "d"), ("b", "c"), 1)}


def test_inheritance(spark):
    nodes = spark.createDataFrame([(i, x, "class", x, x, "a") for i, x in enumerate("ABC")], "node_seq long, id string, kind string, name string, qname string, path string")
    edges = spark.createDataFrame([(0, "A", "B", "inherit", None), (1, "B", "C", "inherit", None), (2, "C", "A", "inherit", None)], "edge_seq long, src string, dst string, kind string, method string")
    assert [(r.depth, r.id) for r in graph.chain(nodes, edges, start(spark, "A")).orderBy("depth").collect()] == [(1, "B"), (2, "C")]


def test_search(spark):
    nodes, _, ids = shop(spark)
    top = search.discover(nodes, "BillingService").orderBy("rank").collect()
    assert top[0].id == ids[2]
    assert search.resolve_anchor(nodes, ids[3])[0] == "resolved"
    status, found = search.resolve_anchor(nodes, "settle")
    assert status == "resolved" and found.first().id == ids[3]
    assert search.resolve_anchor(nodes, "billing")[0] == "ambiguous"
    assert search.resolve_anchor(nodes, "zzz")[0] == "not_found"
    picked = search.resolve_all(nodes, [{"query": "billing"}, {"query": "zzz"}], True, True)
    assert (picked["status"], picked["ids"], picked["missing"]) == ("resolved", [ids[2]], ["zzz"])
    row = {"WidgetDiscovery": ("class", "retrieval.WidgetDiscovery", "src/discovery.ts"), "getDiscovery": ("method", "X.getDiscovery", "src/x.ts")}
    two = spark.createDataFrame([(n, k, kind, k, q.split(".")[1] if kind == "class" else q, p) for n, (k, (kind, q, p)) in enumerate(row.items())], "node_seq long, id string, kind string, name string, qname string, path string")
    assert {r.id: round(r.score, 6) for r in search.discover(two, "discovery").collect()} == {"WidgetDiscovery": 16.8, "getDiscovery": 11.8}


def test_strategy(spark):
    from pyspark.sql import functions as F

    asked = {"where is the login defined": "locate", "how does the login flow work": "flow", "what will break if I change this": "impact", "hello": "locate"}
    df = spark.createDataFrame([(q,) for q in asked], "q string").withColumn("s", search.strategy(F.col("q")))
    assert {r.q: r.s for r in df.collect()} == asked


def test_evidence(spark):
    text = "// first\n// second\n\nfunction pay(x) {\n  return x;\n}\nfunction go() {\n  pay(1);\n}\n/* a\n b */\nclass Z {}\n"
    files = spark.createDataFrame([("a.ts", text)], "path string, source string")
    lines = evidence.lines_of(files)
    wants = spark.createDataFrame([("a.ts", 3), ("a.ts", 11), ("a.ts", 6)], "path string, line_no int")
    assert {r.line_no: r.comment for r in evidence.preceding_comments(wants, lines).collect()} == {3: "// first\n// second", 11: "/* a\nb */", 6: None}
    more = "a()\n/* one */\nb()\n\n// x\n\n\n# y\n  # z\t\ndef f():\n"
    wants = spark.createDataFrame([("b", 2), ("b", 9), ("b", 6), ("b", 0)], "path string, line_no int")
    found = {r.line_no: r.comment for r in evidence.preceding_comments(wants, evidence.lines_of(spark.createDataFrame([("b", more)], "path string, source string"))).collect()}
    assert found == {0: None, 2: "a()\n/* one */", 6: "// x", 9: "# y\n# z"}
    calls = spark.createDataFrame([("a.ts", "pay", 0, 9)], "path string, name string, from_line int, to_line int")
    assert evidence.callsites(calls, lines).first().line_no == 7
    spans = spark.createDataFrame([("a", 1, 4), ("a", 9, 12), ("a", 18, 20), ("b", 1, 2)], "path string, start_line int, end_line int")
    assert sorted((r.path, r.start_line, r.end_line) for r in budget.merge_spans(spans, ("path",)).collect()) == [("a", 1, 12), ("a", 18, 20), ("b", 1, 2)]


def test_budget(spark):
    rows = spark.createDataFrame([(0, "a", "function", "anchor", 10, 100), (1, "b", "class", "path", 10, 100), (2, "c", "function", "path", 10, 10_000)], "seq long, id string, kind string, role string, base long, source_chars long")
    assert {r.id: r.level for r in budget.allocate(rows, 2000).collect()} == {"a": "FULL", "b": "SIGNATURE", "c": "SNIPPET"}
    assert {r.id: r.level for r in budget.allocate(rows, 20).collect()} == {"b": "OMIT", "c": "OMIT", "a": "OMIT"}


def test_replace(spark):
    rows = spark.createDataFrame([("x", "a.py"), ("y", "b.py")], "id string, path string")
    new = spark.createDataFrame([("z", "a.py"), ("y", "a.py")], "id string, path string")
    assert sorted(tuple(r) for r in merge.replace_file(rows, "a.py", new).collect()) == [("y", "b.py"), ("z", "a.py")]
    assert merge.replace_file(rows, "a.py", None).count() == 1


def test_scan_rules(tmp_path):
    rules = scan.IgnoreRules("# c\n*.log\nout/\n!keep.log\n/top.py\nsrc/gen\n")
    assert rules.ignores("a/b.log", False) and not rules.ignores("keep.log", False) and rules.ignores("x/out", True) and not rules.ignores("x/out", False)
    assert rules.ignores("top.py", False) and not rules.ignores("a/top.py", False) and rules.ignores("src/gen", True)
    for p in ("a.py", "b.txt", ".c.py", "build/d.py", "e/f.TSX"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    assert scan.list_files(str(tmp_path)) == ["a.py", "e/f.TSX"]


def test_store(spark, tmp_path):
    nodes, edges, _ = shop(spark)
    store.save({"nodes": nodes, "edges": edges}, str(tmp_path / "t"))
    assert store.load(spark, str(tmp_path / "t"), ("edges",))["edges"].count() == edges.count()
    at = store.export_json({"edges": edges}, {"projectId": "p"}, str(tmp_path))
    assert store.find_document(str(tmp_path)) == at
    assert store.report({"nodes": nodes}).collect()[0].n == 7


def test_watch(spark, tmp_path):
    import datetime as dt

    first = dt.datetime(2026, 1, 1)
    rows = [("a.py", first), ("b.py", first + dt.timedelta(milliseconds=400)), (".git/x", first + dt.timedelta(seconds=4)), ("c.py", first + dt.timedelta(seconds=9)), ("d.py", first + dt.timedelta(hours=1))]
    changes = spark.createDataFrame(rows, "path string, ts timestamp")
    assert [r.n for r in watch.sessions(changes).orderBy("session_start").collect()] == [2, 1, 1, 1]
    source = str(tmp_path / "in")
    changes.coalesce(1).write.parquet(source)
    calls = []
    query = watch.watch_and_rebuild(spark.readStream.schema(changes.schema).parquet(source), lambda: calls.append(1), str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    assert calls == [1]


def test_deep_walks(spark):
    """Walks go on until they end, however deep, and end in cycles."""
    n = 70
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    edges = spark.createDataFrame([(i, i + 1, "owns", i) for i in range(n - 1)] + [(n - 1, 0, "owns", n)], "src long, dst long, kind string, edge_seq long")
    root = nodes.where("id = 0")
    assert sorted(r.depth for r in graph.chain(nodes, edges, root, ("owns",)).collect()) == list(range(1, n))
    assert sorted(r.id for r in views.closure(edges, root).collect()) == list(range(n))
    scopes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)] + [(100, 101), (101, 100)], "id long, parent_scope_id long")
    got = indexes.scope_ancestors(scopes).where("scope_id in (39, 100)").collect()
    assert sorted((r.scope_id, r.depth, r.anc_id) for r in got) == [(39, d, 39 - d) for d in range(40)] + [(100, 0, 100), (100, 1, 101)]


def test_comment_far_above(spark):
    """Blank lines between a comment and its line don't count, however many."""
    source = "\n".join(["x = 1", "# far", *[""] * 60, "def f():"])
    lines = evidence.lines_of(spark.createDataFrame([("p", source), ("q", "\n\ndef g():")], "path string, source string"))
    wants = spark.createDataFrame([("p", 62), ("q", 2)], "path string, line_no int")
    assert {r.path: r.comment for r in evidence.preceding_comments(wants, lines).collect()} == {"p": "# far", "q": None}


def test_json_document_round_trip(spark, tmp_path):
    """What is written as one document can be read as tables again."""
    from codestrata.extract import facts

    files = spark.createDataFrame([(0, "a.py", "python", "import os\nclass A(B):\n    def m(self):\n        x = A()\n        os.f()\n"), (1, "b.py", "python", "def (:\n")], "file_seq long, path string, lang string, source string")
    tables = facts.tables(facts.extract(files))
    store.export_json(tables, {"projectId": "p"}, str(tmp_path))
    loaded = store.load_json(spark, str(tmp_path))
    plain = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    assert all(plain(loaded[t]) == plain(df) for t, df in tables.items()) and loaded["symbols"].count() == 4
    assert loaded["externals"].count() == 0


def test_peripheral_paths(spark):
    from pyspark.sql import functions as F

    paths = ["src/a.ts", "tests/a.ts", "src/a.test.ts", "src/test_a.py", "scratch/x.py", "src/contest.py", "lib/__tests__/x.js", "src/spec-x.js", "mock/x.py", "src\\tests\\x.py"]
    found = spark.createDataFrame([(p,) for p in paths], "p string").select("p", search.is_peripheral(F.col("p")).alias("a"), search.is_peripheral_anchor(F.col("p")).alias("b"), graph.is_test_file(F.col("p")).alias("c")).collect()
    assert {r.p for r in found if r.a} == set(paths) - {"src/a.ts", "src/contest.py"}
    assert {r.p for r in found if r.b} == {"tests/a.ts", "src/a.test.ts", "scratch/x.py", "src\\tests\\x.py"}
    assert {r.p for r in found if r.c} == {"src/a.test.ts", "src/test_a.py", "src\\tests\\x.py"}


def test_confidence_rule(spark):
    from pyspark.sql import functions as F

    cases = {(4, 1, 0): "weak coverage", (2, 1, 1): "too thin", (2, 2, 0): "no connections", (3, 3, 1): None, (1, 1, 0): None}
    df = spark.createDataFrame(list(cases), "q int, r int, f int")
    assert {(r.q, r.r, r.f): r.c for r in df.withColumn("c", traverse.confidence(F.col("q"), F.col("r"), F.col("f"))).collect()} == cases


def test_replaced_files_and_views(spark):
    edges = spark.createDataFrame([("a::x", "b::y"), ("b::y", "c::z"), ("c::z", "c::w")], "src string, dst string")
    new = spark.createDataFrame([("b::q", "c::z"), ("c::w", "c::z")], "src string, dst string")
    assert sorted(map(tuple, merge.replace_edges(edges, "b", new).collect())) == [("b::q", "c::z"), ("c::z", "c::w")]
    held = spark.createDataFrame([(0, "a::x", "a::y"), (1, "b::x", "b::y")], "cont_seq long, parent_id string, child_id string")
    assert [r.cont_seq for r in merge.replace_containments(held, "a", None).collect()] == [1]
    nodes, edges, ids = shop(spark)
    assert sorted((r.direction, r.edge_kind, r.id) for r in views.relations(nodes, edges, ids[6]).collect()) == [("outgoing", "call", ids[3])] * 2
    shown = views.visible(nodes, edges, "settle")
    assert {r.id for r in shown.collect()} == set(ids[:4])
    assert {(r.src, r.dst) for r in views.visible_edges(edges, shown, ("has_member",)).collect()} == {(ids[2], ids[3])}
    watch.swap({"nodes": nodes})
    assert spark.sql("SELECT count(*) FROM model_nodes").first()[0] == len(ids)
    watch.swap({"nodes": nodes.limit(2)})
    assert spark.sql("SELECT count(*) FROM model_nodes").first()[0] == 2


def test_unresolved_names_in_text():
    from codestrata.plans import serialize

    assert serialize.unresolved([{"raw_name": "a.b"}, {"raw_name": "a.b"}, {"raw_name": "x\n y"}]) == "a.b, x y"
    assert serialize.unresolved([{"raw_name": f"n{i}" * 30} for i in range(7)]).endswith(" +2 more")


def test_cut_tables_can_be_removed(spark):
    from codestrata import lineage

    kept = lineage.cut(spark.range(5).toDF("x"))
    assert kept.count() == 5 and lineage.clear(spark) >= 1 and lineage.clear(spark) == 0
