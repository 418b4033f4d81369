"""The engine's queries over the relational tables seen as a graph, each as a function of (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .extract import facts
from .operators import budget, evidence, graph, indexes, resolve, search, traverse, views
from .plans import engine
from .plans import plan as plans
from .projects import source_files
from .sources import scan
from .streaming import watch
from .tables import graph_from_tables, read


def _ids(spark, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id string, rank long")


_built: dict = {}


def project(spark, d) -> engine.Graph:
    """The project that the tables are written as, read and resolved; built once for all queries of a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _built:
        _built[key] = engine.build(spark, "shop", source_files(spark, d))
    return _built[key]


def source_symbols(spark, d):
    """What readers of four languages define, where, and how it is seen."""
    symbols = facts.tables(facts.extract(source_files(spark, d)))["symbols"]
    return symbols.select("id", "kind", "qname", "sl", "el", "exported", "visibility")


def source_references(spark, d):
    refs = facts.tables(facts.extract(source_files(spark, d)))["refs"]
    return refs.select("from_id", "kind", "raw_name", "sl", F.coalesce("import_path", F.lit("")).alias("import_path"))


def source_scopes(spark, d):
    """Scopes with the kind of their parents, and local types."""
    t = facts.tables(facts.extract(source_files(spark, d)))
    scopes = t["scopes"].select("owner_symbol_id", "kind", F.coalesce(F.split_part("parent_scope_id", F.lit(":"), F.lit(3)), F.lit("")).alias("parent"))
    return scopes.unionAll(t["local_bindings"].select("owner_symbol_id", F.lit("local").alias("kind"), F.array_join("type_chain", ".").alias("parent")))


def framework_tags(spark, d):
    """Endpoints, data models and services."""
    tagged = facts.tables(facts.extract(source_files(spark, d)))["symbols"].where("api_method is not null or table_name is not null or is_service")
    empty = F.lit("")
    return tagged.select("id", F.coalesce("api_method", empty).alias("api_method"), F.coalesce("api_path", empty).alias("api_path"), F.coalesce("table_name", empty).alias("table_name"), "is_service")


def import_targets(spark, d):
    """The file that each import means."""
    files = source_files(spark, d)
    refs = facts.tables(facts.extract(files))["refs"].where("kind = 'import'")
    found = resolve.target_files(refs, files.select("file_seq", "path"))
    return refs.join(found.hint("merge"), "ref_seq").select("path", "raw_name", "file")


def resolved_references(spark, d):
    """All references of the project that are resolved: imports, scopes, local types, members, names anywhere, built-in and outside names."""
    return project(spark, d).tables["resolved_refs"].select("from_id", "to_id", "kind", "method")


def project_diagnostics(spark, d):
    return project(spark, d).tables["diagnostics"].select("kind", "severity", "message", "path", "sl")


def outside_names(spark, d):
    g = project(spark, d)
    held = g.tables["containments"].where(F.col("child_id").startswith("external::")).select(F.col("child_id").alias("id"), "parent_id")
    return g.tables["externals"].select("id", "kind", "qname").join(held.hint("merge"), "id", "left").withColumn("parent_id", F.coalesce("parent_id", F.lit("")))


def project_graph(spark, d):
    """Nodes and edges of the graph that build_graph makes of the project, by kind."""
    g = project(spark, d)
    nodes = g.nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "kind", F.lit("").alias("method"), "n")
    return nodes.unionAll(g.edges.groupBy("kind", F.coalesce("method", F.lit("")).alias("method")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "kind", "method", "n"))


def project_slices(spark, d):
    """Source, signature and preceding comment of the classes' members."""
    g = project(spark, d)
    members = g.nodes.where("kind in ('function', 'method') and id like '%::%::%' and path <> 'external'").select("id", "path", "sl", "el")
    shown = evidence.slices(members, g.files)
    comments = evidence.preceding_comments(members.select("path", F.col("sl").alias("line_no")), evidence.lines_of(g.files)).withColumnRenamed("line_no", "sl")
    return shown.join(comments.hint("merge"), ["path", "sl"], "left").select("id", F.sha2("source", 256).alias("source_sha"), "signature", F.coalesce("comment", F.lit("")).alias("comment"))


def symbol_spans(spark, d):
    """Merged line spans of the project's symbols, file by file."""
    g = project(spark, d)
    spans = g.nodes.where("kind not in ('file', 'project')").where(~F.col("id").startswith("external::")).select("path", F.col("sl").alias("start_line"), F.col("el").alias("end_line"))
    return budget.merge_spans(spans, ("path",)).select("path", *(F.col(c).cast("long").alias(c) for c in ("start_line", "end_line", "n")))


def answer_relations(spark, d):
    """The relationships in the text of an answer: what a region around a nation's function holds."""
    text = engine.Engine(project(spark, d)).answer(plans.explore_region(["pkg/nation_3.py::run_3"], "outgoing", 2))["text"].split("\n")
    lines = text[text.index("# Relationships") + 1 : text.index("# Code")]
    return spark.createDataFrame([(x,) for x in [*lines, *(x for x in text if x.startswith("Resolution confidence"))]], "line string")


def graph_stats(spark, d):
    return graph.stats(*graph_from_tables(spark, d))


def callers_of(spark, d):
    return graph.callers_of(*graph_from_tables(spark, d), _ids(spark, "p:1", "p:7", "p:11")).select("of_id", "edge_seq", "id")


def callees_of(spark, d):
    return graph.callees_of(*graph_from_tables(spark, d), _ids(spark, "o:1", "o:2", "o:33")).select("of_id", "edge_seq", "id")


def members_of(spark, d):
    return graph.members_of(*graph_from_tables(spark, d), _ids(spark, "c:1", "c:4", "c:10")).select("of_id", "edge_seq", "id")


def imports_of(spark, d):
    """References from line items to suppliers count as imports here."""
    nodes, edges = graph_from_tables(spark, d)
    edges = edges.withColumn("kind", F.when(F.col("kind") == "type_use", "import").otherwise(F.col("kind")))
    return graph.imports_of(nodes, edges, _ids(spark, "o:1", "o:2", "o:33")).select("of_id", "edge_seq", "id")


def find_by_name(spark, d):
    nodes, _ = graph_from_tables(spark, d)
    return graph.find_by(nodes, "name", "NATION_3").select("id", "kind", "qname")


def region_both_d2(spark, d):
    nodes, _, _ = traverse.region(*graph_from_tables(spark, d), _ids(spark, "c:1"), "both", (), 2)
    return nodes.select("id", F.col("distance").cast("int").alias("distance"))


def region_out_d3(spark, d):
    nodes, _, _ = traverse.region(*graph_from_tables(spark, d), _ids(spark, "n:3", "c:1"), "outgoing", (), 3)
    return nodes.select("id", F.col("distance").cast("int").alias("distance"))


def region_kind_filter(spark, d):
    _, edges, _ = traverse.region(*graph_from_tables(spark, d), _ids(spark, "c:1", "c:4"), "both", ("Calls", "has_members"), 3)
    return edges.select("src", "dst", "kind")


def region_capped(spark, d):
    nodes, _, _ = traverse.region(*graph_from_tables(spark, d), _ids(spark, "c:1"), "both", (), 2, 60, None, 10)
    return nodes.select("id", F.col("distance").cast("int").alias("distance"))


def region_edge_topk(spark, d):
    _, edges, left_out = traverse.region(*graph_from_tables(spark, d), _ids(spark, "c:1"), "outgoing", (), 2, 200, 15)
    return edges.select("src", "dst", "kind", F.col("edge_rank").cast("int").alias("edge_rank"), F.lit(left_out).cast("long").alias("omitted"))


def shortest_paths(spark, d):
    _, edges = graph_from_tables(spark, d)
    found = traverse.paths(edges, "r:1", "p:1", (), 6, 10)
    return found.select(F.col("path_rank").cast("int").alias("path_rank"), F.array_join("path", ">").alias("path"), F.array_join("kinds", ">").alias("kinds"))


def impact_cone(spark, d):
    nodes, _ = traverse.impact(*graph_from_tables(spark, d), _ids(spark, "p:1"), 3, None)
    return nodes.select("id", F.col("distance").cast("int").alias("distance"), F.coalesce("via", F.lit("")).alias("via"))


def _expanded(found: DataFrame) -> DataFrame:
    return found.select("id", F.col("distance").cast("int").alias("distance"))


def expand_locate(spark, d):
    return _expanded(traverse.locate(*graph_from_tables(spark, d), _ids(spark, "c:1")))


def expand_flow(spark, d):
    return _expanded(traverse.flow(*graph_from_tables(spark, d), _ids(spark, "o:1")))


def expand_impact(spark, d):
    return _expanded(traverse.impacted(*graph_from_tables(spark, d), _ids(spark, "s:1")))


def ancestor_chain(spark, d):
    nodes, edges = graph_from_tables(spark, d)
    some = nodes.where(F.col("kind") == "class").select("id")
    return graph.chain(nodes, edges, some, ("owns", "has_member"), up=False).select("of_id", F.col("depth").cast("int").alias("depth"), "id")


def neighborhood(spark, d):
    nodes, edges = graph.neighborhood(*graph_from_tables(spark, d), _ids(spark, "o:1"), 2)
    return nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "kind", "n").unionAll(edges.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "kind", "n"))


def flow_between(spark, d):
    _, edges = graph_from_tables(spark, d)
    first = edges.where((F.col("src") == "o:1") & (F.col("kind") == "call")).orderBy("edge_seq").limit(2).select("dst").collect()
    found = traverse.flow_between(edges, ["o:1", *(r[0] for r in first)])
    return found.select(F.array_join("path", ">").alias("path"), F.array_join("kinds", ">").alias("kinds"))


def blast_radius(spark, d):
    nodes, edges = graph_from_tables(spark, d)
    parts = nodes.where(F.col("kind") == "interface")
    return traverse.blast_radius(nodes, edges, parts.select("id")).select("id", "references", "n_files", "files")


def test_coverage(spark, d):
    """Orders of status F count as tests here."""
    nodes, edges = graph_from_tables(spark, d)
    tests = nodes.withColumn("path", F.when(F.col("path") == "F", F.lit("src/tests/f.py")).otherwise(F.col("path")))
    covered = graph.with_coverage(tests, edges).withColumn("state", graph.coverage_state(F.col("kind"), F.col("test_covered")))
    return covered.groupBy("kind", "state").agg(F.count("*").alias("n"))


def discover_parts(spark, d):
    nodes, _ = graph_from_tables(spark, d)
    found = search.discover(nodes.where(F.col("kind") == "interface"), "how does the Brand#1 part 17 work", 25)
    return found.select("id", "score", F.col("rank").cast("int").alias("rank"))


def endpoint_search(spark, d):
    """Orders as endpoints: a method and a path in the query find theirs."""
    nodes, _ = graph_from_tables(spark, d)
    routes = nodes.where(F.col("id").startswith("o:")).withColumns({"api_method": F.lit("GET"), "api_path": F.concat(F.lit("/"), F.substring("name", 7, 99))})
    found = search.discover(routes, "what serves GET /17", 25)
    return found.select("id", "score", F.col("rank").cast("int").alias("rank"))


def anchors_of_specs(spark, d):
    """Several anchors at once: what was found, in order, and what is missing."""
    nodes, _ = graph_from_tables(spark, d)
    picked = search.resolve_all(nodes, [{"query": "NATION_3"}, {"query": "zzzz"}, {"query": "Order#1"}, {"query": "qqqq"}], True, True)
    rows = [(picked["status"], "id", i) for i in picked["ids"]] + [(picked["status"], "missing", q) for q in picked["missing"]]
    return spark.createDataFrame(rows, "status string, what string, value string")


def anchor_exact(spark, d):
    nodes, _ = graph_from_tables(spark, d)
    status, found = search.resolve_anchor(nodes, "Nation_3.Nation_3")
    return found.select("id", F.lit(status).alias("status"), F.col("rank").cast("int").alias("rank"))


def anchor_ambiguous(spark, d):
    """Customers by market segment as names: many have the same."""
    nodes, _ = graph_from_tables(spark, d)
    named = nodes.withColumn("name", F.when(F.col("id").startswith("c:"), F.lit("Shared")).otherwise(F.col("name"))).where(F.col("kind") == "class")
    status, found = search.resolve_anchor(named, "shared")
    return found.select("id", F.lit(status).alias("status"), F.col("rank").cast("int").alias("rank"))


def plan_strategy(spark, d):
    """Which strategy turns of conversations would get, with a question put before them."""
    turns = read(spark, d, "conversations")
    asked = F.concat(F.element_at(F.array(*map(F.lit, ("how does the ", "what will break if I change ", "where is ", ""))), (F.pmod("conv_id", F.lit(4)) + 1).cast("int")), F.coalesce("text", F.lit("")))
    return turns.select("conv_id", "turn", search.strategy(asked).alias("strategy"))


def flow_terms(spark, d):
    turns = read(spark, d, "conversations")
    return turns.select("conv_id", "turn", F.array_join(search.flow_terms(F.coalesce("text", F.lit(""))), " ").alias("terms"))


def span_merge(spark, d):
    """Minutes of the day as lines: spans of each user's events, 3 lines long."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    spans = read(spark, d, "events").select("user_id", minute.alias("start_line"), (minute + 2).alias("end_line"))
    return budget.merge_spans(spans, ("user_id",)).select("user_id", *(F.col(c).cast("long").alias(c) for c in ("span", "start_line", "end_line", "n")))


def budget_alloc(spark, d):
    """Documents of each source share a budget; their length says which role they play."""
    role = F.when(F.col("n_chars") % 5 == 0, "anchor").when(F.col("n_chars") % 5 == 1, "path").when(F.col("n_chars") % 5 == 2, "impacted").when(F.col("n_chars") % 5 == 3, "direct_neighbor").otherwise("transitive_neighbor")
    kind = F.when(F.col("n_chars") % 7 == 0, "class").otherwise("function")
    rows = read(spark, d, "documents").select("source", F.col("doc_id").alias("seq"), F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("id"), kind.alias("kind"), role.alias("role"), (40 + F.col("n_chars") % 100).alias("base"), F.col("n_chars").alias("source_chars"))
    return budget.allocate(rows, 8000, ("source",)).select("source", "id", "level")


def confidence_summary(spark, d):
    _, edges = graph_from_tables(spark, d)
    low = F.col("method") == "global_fallback"
    refs = edges.where(F.col("method").isNotNull())
    return refs.groupBy("kind").agg(F.count_if(low).alias("low"), F.count_if(~low).alias("high"))


def innermost_scope(spark, d):
    """Orders of a customer as scopes over time: from the order date on, longer for dearer ones. Which is the smallest around each order's start, its own apart?"""
    o = read(spark, d, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    path = F.col("o_custkey").cast("string")
    days = (F.col("o_totalprice") / 1000).cast("int")
    scopes = o.select(F.col("o_orderkey").alias("scope_seq"), F.col("o_orderkey").cast("string").alias("id"), path.alias("path"), F.col("o_orderkey").cast("string").alias("owner_symbol_id"), day.alias("sl"), F.lit(0).alias("sc"), (day + days).alias("el"), F.lit(0).alias("ec"))
    symbols = o.select(F.col("o_orderkey").cast("string").alias("id"), path.alias("path"), day.alias("sl"), F.lit(0).alias("sc"), day.alias("el"), F.lit(0).alias("ec"))
    return indexes.innermost(symbols, scopes, exclude_own=True).select("id", "scope_id")


def name_resolution(spark, d):
    """Each line item names a supplier: the one of its customer's nation with this key modulo 5 first, else any with it, else none."""
    o, c, s = (read(spark, d, n) for n in ("orders", "customer", "supplier"))
    wants = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("ref_seq"), F.col("c_nationkey").alias("nation"), F.pmod("o_orderkey", F.lit(130)).alias("name"))
    offers = s.select(F.col("s_suppkey").alias("sym_seq"), F.pmod("s_suppkey", F.lit(128)).alias("name"), F.col("s_nationkey").alias("nation"))
    # of equal offers the first, so that a reference meets one supplier at each step, however many share the name
    nearest, anywhere = resolve.first_by(offers, "sym_seq", "name", "nation"), resolve.first_by(offers, "sym_seq", "name")
    steps = [("scope", wants.join(nearest, ["name", "nation"])), ("global_fallback", wants.join(anywhere, "name"))]
    found = resolve.first_of(steps, "ref_seq", "sym_seq")
    return wants.join(found, "ref_seq", "left").select("ref_seq", F.col("sym_seq").alias("target"), F.coalesce("method", F.lit("unresolved")).alias("method"))


def module_deps(spark, d):
    return views.module_deps(*graph_from_tables(spark, d))


def _services(nodes):
    return nodes.where(F.col("id").startswith("c:") & F.col("exported")).select("id")


def service_deps(spark, d):
    """Customers as services; orders refer to others' suppliers through an added reference from each order to the next customer."""
    nodes, edges = graph_from_tables(spark, d)
    o = read(spark, d, "orders")
    more = o.select((F.lit(6 * 10**13) + F.col("o_orderkey")).alias("edge_seq"), F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("src"), F.concat(F.lit("c:"), (F.col("o_custkey") + 1).cast("string")).alias("dst"), F.lit("call").alias("kind"), F.lit("scope").alias("method"))
    return views.service_deps(nodes, edges.unionAll(more), _services(nodes))


def data_access(spark, d):
    nodes, edges = graph_from_tables(spark, d)
    return views.data_access(edges, nodes.where(F.col("id").startswith("s:")).select("id"), _services(nodes))


def api_routes(spark, d):
    handlers = read(spark, d, "pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("id"), F.lit("GET").alias("api_method"), F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1).alias("api_path"))
    return views.api_routes(handlers)


def trace_flow(spark, d):
    nodes, edges = graph_from_tables(spark, d)
    return views.trace(nodes, edges, "c:1", _services(nodes), 2).select(F.col("depth").cast("int").alias("depth"), "src", "dst")


def flat_view(spark, d):
    nodes, edges = views.flat(*graph_from_tables(spark, d))
    return edges.groupBy("kind").agg(F.count("*").alias("n"))


def kind_counts(spark, d):
    return views.kind_counts(graph_from_tables(spark, d)[0])


def one_hop_ids(spark, d):
    return views.one_hop_ids(graph_from_tables(spark, d)[1], "o:1")


def visible_nodes(spark, d):
    nodes, edges = graph_from_tables(spark, d)
    return views.visible(nodes, edges, "customer#00000001", ("class",)).select("id")


def incremental_update(spark, d):
    """Orders of status P are replaced by those of the first half of the table, as finished ones."""
    nodes, _ = graph_from_tables(spark, d)
    from .operators.merge import replace_file

    new = nodes.where(F.col("id").startswith("o:") & (F.col("node_seq") % 2 == 0)).withColumn("path", F.lit("P"))
    return replace_file(nodes.where(F.col("id").startswith("o:")), "P", new).groupBy("path").agg(F.count("*").alias("n"))


def debounce_sessions(spark, d):
    found = watch.sessions(read(spark, d, "events"), "10 minutes", ("user_id",))
    return found.select("user_id", "session_start", "last_change", "n")


def callsite_search(spark, d):
    """The first line after the first of each document that has the document's first word again."""
    docs = read(spark, d, "documents").select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("source"))
    name = F.regexp_extract("source", "([A-Za-z]+)", 1)
    wants = docs.select("doc_id", name.alias("name"), F.lit(1).alias("from_line"), F.lit(10**9).alias("to_line")).where(F.length("name") > 0)
    lines = evidence.lines_of(docs, "doc_id")
    return evidence.callsites(wants, lines, "doc_id").select("doc_id", F.col("line_no").cast("int").alias("line_no"))


def doc_comment(spark, d):
    """Lines of documents as code: every second line of a document is a comment before the line that follows."""
    lines = evidence.lines_of(read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("source")), "doc_id")
    coded = lines.withColumn("text", F.when(F.col("line_no") % 2 == 0, F.concat(F.lit("# "), F.col("text"))).otherwise(F.col("text")))
    wants = lines.groupBy("doc_id").agg(F.max("line_no").alias("line_no"))
    found = evidence.preceding_comments(wants, coded, "doc_id")
    return found.select("doc_id", F.sha2(F.coalesce("comment", F.lit("")), 256).alias("comment_sha"))


def html_refs(spark, d):
    """Ids, scripts and links of pages, which get one of each before their own, as the reader of HTML finds them."""
    key = F.col("page_id").cast("string")
    put = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    tags = put('<div id="top-', key, '"></div><script src="/js/', F.pmod("page_id", F.lit(7)).cast("string"), '.js"></script><link rel="x" href="/c/', F.pmod("page_id", F.lit(3)).cast("string"), '.css">\n', F.coalesce("html", F.lit("")))
    files = read(spark, d, "pages").select(F.col("page_id").cast("long").alias("file_seq"), put(key, ".html").alias("path"), F.lit("html").alias("lang"), tags.alias("source"))
    found = facts.tables(facts.extract(files))
    page = F.split_part("path", F.lit("."), F.lit(1)).cast("long").alias("page_id")
    ids = found["symbols"].where("kind = 'variable'").select(page, F.lit("id").alias("tag"), "name")
    return ids.unionAll(found["refs"].where("kind = 'import'").select(page, F.lit("import").alias("tag"), F.col("raw_name").alias("name")))


def token_estimate(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", budget.tokens_for(F.length(F.coalesce("text", F.lit("")))).cast("long").alias("tokens"))


def scan_filter(spark, d):
    """Urls of pages as paths: which would a scan take, and as what language?"""
    path = F.regexp_replace("url", "^[a-z]+://", "")
    pages = read(spark, d, "pages").select("page_id", path.alias("path"))
    return pages.select("page_id", (scan.excluded(F.col("path")) | scan.hidden(F.col("path"))).alias("skipped"), F.coalesce(scan.language(F.col("path")), F.lit("")).alias("lang"))


QUERIES = {f.__name__: f for f in (
    graph_stats, callers_of, callees_of, members_of, imports_of, find_by_name, region_both_d2, region_out_d3, region_kind_filter, region_capped, region_edge_topk, shortest_paths, impact_cone,
    expand_locate, expand_flow, expand_impact, ancestor_chain, neighborhood, flow_between, blast_radius, test_coverage, discover_parts, endpoint_search, anchors_of_specs, anchor_exact, anchor_ambiguous, plan_strategy, flow_terms,
    span_merge, budget_alloc, confidence_summary, innermost_scope, name_resolution, module_deps, service_deps, data_access, api_routes, trace_flow, flat_view, kind_counts, one_hop_ids, visible_nodes,
    source_symbols, source_references, source_scopes, framework_tags, import_targets, resolved_references, project_diagnostics, outside_names, project_graph, project_slices, symbol_spans, answer_relations,
    incremental_update, debounce_sessions, callsite_search, doc_comment, html_refs, token_estimate, scan_filter,
)}
