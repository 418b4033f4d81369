"""The property graph and its point queries.

nodes(node_seq, id, kind, name, qname, path, ...) and edges(edge_seq, src, dst, kind, method): a directed
multigraph whose edges may point at ids without a node. The *_seq columns give the order in which rows count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from ..model import TESTABLE_KINDS


def is_test_file(path: Column) -> Column:
    """Coverage's idea of a test file."""
    p = F.lower(F.translate(path, "\\", "/"))
    return p.rlike("/tests?/") | p.rlike(r"\.(test|spec)\.[a-z]+$") | p.rlike(r"(^|/)test_[^/]+\.py$") | p.rlike(r"(^|/)[^/]+_test\.py$")


def build_graph(symbols: DataFrame, containments: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (the last of equal ids) and edges: containments, then imports, then other references."""
    node = symbols.groupBy("id").agg(F.max_by(F.struct(*symbols.columns), "sym_seq").alias("s")).select("s.*").withColumnRenamed("sym_seq", "node_seq")
    rank = lambda block, seq: (F.lit(block).cast("long") * 10**15 + F.col(seq)).alias("edge_seq")
    contained = containments.select(rank(0, "cont_seq"), F.col("parent_id").alias("src"), F.col("child_id").alias("dst"), "kind", F.lit(None).cast("string").alias("method"))
    block = F.when(F.col("kind") == "import", 1).otherwise(2)
    referred = resolved.select((block.cast("long") * 10**15 + F.col("ref_seq")).alias("edge_seq"), F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "kind", "method")
    edges = contained.unionByName(referred)
    return with_coverage(node, edges), edges


def with_coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with test_covered: a reference from a test file points at it."""
    sources = nodes.where(is_test_file(F.col("path"))).select(F.col("id").alias("src"))
    covered = edges.where(F.col("method").isNotNull()).join(sources, "src", "left_semi").select(F.col("dst").alias("id")).distinct().withColumn("test_covered", F.lit(True))
    return nodes.join(covered, "id", "left").withColumn("test_covered", F.coalesce("test_covered", F.lit(False)))


def coverage_state(kind: Column, covered: Column) -> Column:
    """Covered or not; null for kinds that tests don't cover."""
    return F.when(kind.isin(*TESTABLE_KINDS), covered)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): nodes and edges in all and by edge kind."""
    by_kind = edges.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("edge_kind").alias("what"), "kind", "n")
    total = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), F.lit("").alias("kind"), "n")
    return by_kind.unionAll(total(edges, "edges")).unionAll(total(nodes, "nodes"))


def one_hop(nodes: DataFrame, edges: DataFrame, of: DataFrame, kinds: tuple[str, ...], incoming: bool) -> DataFrame:
    """(of_id, edge_seq, id, ...) neighbours over edges of some kinds; parallel edges are kept, ids without a node dropped. of(id)."""
    here, there = ("dst", "src") if incoming else ("src", "dst")
    hop = edges.where(F.col("kind").isin(*kinds)).join(of.select(F.col("id").alias(here)), here)
    return hop.select(F.col(here).alias("of_id"), "edge_seq", F.col(there).alias("id")).join(nodes, "id")


def callers_of(nodes, edges, of):
    return one_hop(nodes, edges, of, ("call",), True)


def callees_of(nodes, edges, of):
    return one_hop(nodes, edges, of, ("call",), False)


def members_of(nodes, edges, of):
    return one_hop(nodes, edges, of, ("has_member",), False)


def imports_of(nodes, edges, of):
    return one_hop(nodes, edges, of, ("import",), False)


def find_by(nodes: DataFrame, column: str, value: str) -> DataFrame:
    return nodes.where(F.col(column) == value)


def unresolved_index(unresolved: DataFrame) -> DataFrame:
    """(from_id, refs): unresolved names of each symbol, in order."""
    return unresolved.groupBy("from_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ref_seq", "raw_name", "kind"))), lambda x: F.struct(x["raw_name"].alias("raw_name"), x["kind"].alias("kind"))).alias("refs"))


def chain(nodes: DataFrame, edges: DataFrame, of: DataFrame, kinds: tuple[str, ...] = ("inherit",), up: bool = True) -> DataFrame:
    """(of_id, depth, id): follows each node's first edge of some kinds until it ends, meets a missing node or a node it has passed."""
    here, there = ("src", "dst") if up else ("dst", "src")
    step = edges.where(F.col("kind").isin(*kinds)).groupBy(here).agg(F.min_by(there, "edge_seq").alias("next")).withColumnRenamed(here, "at")
    step = step.join(nodes.select(F.col("id").alias("next")), "next", "left_semi")
    level = of.select(F.col("id").alias("of_id"), F.col("id").alias("at"), F.array("id").alias("passed"))
    found, depth = None, 0
    while True:
        depth += 1
        level = cut(level.join(step, "at").where(~F.array_contains("passed", F.col("next"))).select("of_id", F.col("next").alias("at"), F.concat("passed", F.array("next")).alias("passed")))
        if level.isEmpty():
            break
        row = level.select("of_id", F.lit(depth).alias("depth"), F.col("at").alias("id"))
        found = row if found is None else found.unionAll(row)
        if depth % 16 == 0:
            found = cut(found)
    return of.select(F.col("id").alias("of_id"), F.lit(0).alias("depth"), "id").limit(0) if found is None else found


def subgraph_edges(edges: DataFrame) -> DataFrame:
    """The first of the edges that share ends and kind."""
    first = Window.partitionBy("src", "dst", "kind").orderBy("edge_seq")
    return edges.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def neighborhood(nodes: DataFrame, edges: DataFrame, of: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(id, distance) and edges around some nodes, in both directions over all kinds. Ids without a node are passed through and keep their edges."""
    both = edges.select(F.col("src").alias("at"), F.col("dst").alias("to")).unionAll(edges.select(F.col("dst").alias("at"), F.col("src").alias("to")))
    seen = cut(of.select("id", F.lit(0).alias("distance")).distinct())
    for d in range(1, depth + 1):
        near = seen.where(F.col("distance") == d - 1).withColumnRenamed("id", "at")
        new = near.join(both, "at").select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("distance", F.lit(d))
        seen = cut(seen.unionAll(new))
    inner = seen.where(F.col("distance") < depth).select("id")
    touched = edges.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return nodes.join(seen, "id"), subgraph_edges(touched)
