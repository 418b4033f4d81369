"""Rollups of the model: flat, module, service, API and data views, flow traces, visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..model import CONTAINMENT_KINDS, REFERENCE_KINDS



def contained() -> Column:
    return F.col("kind").isin(*CONTAINMENT_KINDS)


def referring() -> Column:
    return F.col("kind").isin(*REFERENCE_KINDS)


def flat(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols but the project; references between live ends without loops and repeats, and containments but the project's."""
    own = nodes.where(F.col("kind") != "project")
    ids = own.select("id")
    live = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    refs = live.where(referring() & (F.col("src") != F.col("dst"))).select("src", "dst", "kind").distinct()
    holds = live.where(contained()).select("src", "dst").distinct().withColumn("kind", F.lit("contains"))
    return own, refs.unionByName(holds)


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id): everything that some nodes contain, themselves too. roots(id)."""
    holds = edges.where(contained()).select(F.col("src").alias("id"), F.col("dst").alias("child")).distinct()
    level = cut(roots.select(F.col("id").alias("root"), "id").distinct())
    found, depth = level, 0
    while True:
        depth += 1
        level = cut(level.join(holds, "id").select("root", F.col("child").alias("id")).distinct().join(found, ["root", "id"], "left_anti"))
        if level.isEmpty():
            break
        found = found.unionAll(level)
        if depth % 16 == 0:
            found = cut(found)
    return found


def module_deps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src_path, dst_path): files that refer to other files."""
    at = nodes.select("id", "path").where(F.col("path") != "")
    pairs = edges.where(referring()).join(at.select(F.col("id").alias("src"), F.col("path").alias("src_path")), "src").join(at.select(F.col("id").alias("dst"), F.col("path").alias("dst_path")), "dst")
    return pairs.where(F.col("src_path") != F.col("dst_path")).select("src_path", "dst_path").distinct()


def service_owner(nodes: DataFrame, edges: DataFrame, services: DataFrame) -> DataFrame:
    """(id, service): the service that holds each node; of several the later."""
    held = closure(edges, services).join(nodes.select(F.col("id").alias("root"), "node_seq"), "root")
    return held.groupBy("id").agg(F.max_by("root", "node_seq").alias("service"))


def service_deps(nodes: DataFrame, edges: DataFrame, services: DataFrame) -> DataFrame:
    """(src, dst): services that refer to others, also from within what they hold."""
    owner = service_owner(nodes, edges, services)
    pairs = edges.where(referring()).select("src", "dst").join(owner.select(F.col("id").alias("src"), F.col("service").alias("from")), "src").join(owner.select(F.col("id").alias("dst"), F.col("service").alias("to")), "dst")
    return pairs.where(F.col("from") != F.col("to")).select(F.col("from").alias("src"), F.col("to").alias("dst")).distinct()


def api_routes(handlers: DataFrame) -> DataFrame:
    """(route, handler) of nodes with api_method and api_path."""
    return handlers.where(F.col("api_method").isNotNull()).select(F.concat(F.lit("api:"), F.col("api_method"), F.lit(":"), F.col("api_path")).alias("route"), F.col("id").alias("handler"))


def data_access(edges: DataFrame, models: DataFrame, services: DataFrame) -> DataFrame:
    """(src, dst): who refers to data models; a member of a service counts as the service."""
    parent = edges.where(contained()).join(services.select(F.col("id").alias("src")), "src", "left_semi").groupBy("dst").agg(F.max_by("src", "edge_seq").alias("service")).withColumnRenamed("dst", "from")
    uses = edges.where(referring()).join(models.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("from"), "dst").distinct()
    return uses.join(parent, "from", "left").select(F.coalesce("service", "from").alias("src"), "dst").where(F.col("src") != F.col("dst")).distinct()


def trace(nodes: DataFrame, edges: DataFrame, start: str, services: DataFrame, depth: int = 4) -> DataFrame:
    """(depth, src, dst): references level by level from a node and all it holds; what a service holds counts as the service."""
    spark = edges.sparkSession
    direct = edges.where(contained()).join(services.select(F.col("id").alias("src")), "src", "left_semi").groupBy("dst").agg(F.max_by("src", "edge_seq").alias("service"))
    refs = edges.where(referring()).select("src", "dst").distinct()
    level = spark.createDataFrame([(start,)], "id string")
    found = None
    for d in range(1, depth + 1):
        held = closure(edges, level)
        new = held.select("root", F.col("id").alias("src")).join(refs, "src").join(direct, "dst", "left").select(F.col("root").alias("src"), F.coalesce("service", "dst").alias("dst")).where(F.col("src") != F.col("dst")).distinct()
        new = cut(new.select(F.lit(d).alias("depth"), "src", "dst"))
        if new.isEmpty():
            break
        found = new if found is None else found.unionAll(new)
        level = new.select(F.col("dst").alias("id")).distinct()
    return spark.createDataFrame([], "depth int, src string, dst string") if found is None else found


def kind_counts(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("kind") != "project").groupBy("kind").agg(F.count("*").alias("n"))


def one_hop_ids(edges: DataFrame, start: str) -> DataFrame:
    """A node, its references both ways, its children and its (last) parent."""
    refs, holds = edges.where(referring()), edges.where(contained())
    parent = holds.where(F.col("dst") == start).orderBy(F.desc("edge_seq")).limit(1)
    parts = [refs.where(F.col("src") == start).select(F.col("dst").alias("id")), refs.where(F.col("dst") == start).select(F.col("src").alias("id")), holds.where(F.col("src") == start).select(F.col("dst").alias("id")), parent.select(F.col("src").alias("id"))]
    out = edges.sparkSession.createDataFrame([(start,)], "id string")
    for p in parts:
        out = out.unionAll(p)
    return out.distinct()


def relations(nodes: DataFrame, edges: DataFrame, start: str) -> DataFrame:
    """(direction, kind, id, ...): references from and to a node whose other end lives."""
    out = edges.where(referring() & (F.col("src") == start)).select(F.lit("outgoing").alias("direction"), F.col("kind").alias("edge_kind"), F.col("dst").alias("id"))
    back = edges.where(referring() & (F.col("dst") == start)).select(F.lit("incoming").alias("direction"), F.col("kind").alias("edge_kind"), F.col("src").alias("id"))
    return out.unionAll(back).join(nodes, "id")


def visible(nodes: DataFrame, edges: DataFrame, text: str = "", kinds: tuple[str, ...] = ()) -> DataFrame:
    """Nodes of some kinds whose name holds a text, and everything that contains one of them."""
    low = text.lower()
    hit = nodes.where((F.lower("name").contains(low) | F.lower("qname").contains(low)) & (F.col("kind").isin(*kinds) if kinds else F.lit(True))).select("id")
    up = edges.where(contained()).select(F.col("dst").alias("id"), F.col("src").alias("parent")).distinct()
    found = level = cut(hit.distinct())
    while True:
        level = cut(level.join(up, "id").select(F.col("parent").alias("id")).distinct().join(found, "id", "left_anti"))
        if level.isEmpty():
            break
        found = cut(found.unionAll(level))
    return nodes.join(found, "id", "left_semi")


def visible_edges(edges: DataFrame, shown: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    ids = shown.select("id")
    own = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    return own.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
