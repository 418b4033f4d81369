"""Bounded traversals: region, shortest paths, impact, expansion, flow, blast radius.

Levels are driver loops of at most the policy's depth; each level is a join of the frontier with the edges.
Within a level new nodes rank by (rank of the node they were reached from, outgoing before incoming,
edge_seq, id), so caps admit the same nodes in every run. Levels are counted before they are used: up to BROADCAST_ROWS they
are broadcast, and the edges are then scanned without a shuffle; larger ones are joined by a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from ..model import CONTAINMENT_KINDS, DEFAULTS, FLOW_KINDS, LIMITS, REFERENCE_KINDS, TESTABLE_KINDS
from .graph import subgraph_edges

BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int | None) -> DataFrame:
    """df, broadcast where it can't have more than BROADCAST_ROWS rows; most: how many it has at most."""
    return F.broadcast(df) if most is not None and most <= BROADCAST_ROWS else df


def kind_is(kind: Column, kinds) -> Column:
    """Whether a kind is among some, whatever the case and a plural s; no kinds: all."""
    plain = lambda k: k.lower().removesuffix("s")
    return F.regexp_replace(F.lower(kind), "s$", "").isin(*map(plain, kinds)) if kinds else F.lit(True)


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """(at, to, dir, edge_seq, kind): each edge as a step from either end that the direction allows."""
    out = F.struct(F.col("src").alias("at"), F.col("dst").alias("to"), F.lit(0).alias("dir"))
    back = F.struct(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(1).alias("dir"))
    # one scan of the edges, whatever the direction
    way = {"outgoing": out, "incoming": back}.get(direction, F.explode(F.array(out, back)))
    return edges.select(way.alias("way"), "edge_seq", "kind").select("way.*", "edge_seq", "kind")


def walk(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, direction: str, kinds, depth: int, node_limit: int | None = None, per_file: int | None = None) -> DataFrame:
    """(id, distance, rank, via): admitted nodes in the order of admission. anchors(id, rank); via: kind of the edge that found it."""
    step = steps(edges.where(kind_is(F.col("kind"), kinds)), direction)
    place = ["at_rank", "dir", "edge_seq", "id"]
    seen = nodes.select("id").join(small(anchors.select("id", "rank"), anchors.count()), "id").groupBy("id").agg(F.min("rank").cast("long").alias("rank"))
    seen = cut(seen.select("id", F.lit(0).alias("distance"), "rank", F.lit(None).cast("string").alias("via")))
    for d in range(1, depth + 1):
        known, top, last = seen.agg(F.count("*"), F.max("rank"), F.count(F.when(F.col("distance") == d - 1, 1))).first()
        room = None if node_limit is None else node_limit - known
        if not last or room is not None and room <= 0:
            break
        front = seen.where(F.col("distance") == d - 1).select(F.col("id").alias("at"), F.col("rank").alias("at_rank"))
        reached = step.join(small(front, last), "at").groupBy(F.col("to").alias("id")).agg(F.min(F.struct("at_rank", "dir", "edge_seq", "kind")).alias("m")).select("id", "m.*")
        reached = cut(reached.join(small(seen.select("id"), known), "id", "left_anti"))
        reached = nodes.select("id", "path").join(small(reached, reached.count()), "id")
        if per_file is not None and d >= 2:
            used = nodes.select("id", "path").join(small(seen.where("distance > 0").select("id"), known), "id").groupBy("path").agg(F.count("*").alias("used"))
            reached = reached.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy(*place))).where(F.col("n") <= per_file)
            reached = reached.join(small(used, known), "path", "left").where(F.col("n") + F.coalesce("used", F.lit(0)) <= per_file)
        if room is not None:
            reached = reached.orderBy(*place).limit(room)
            ranked = reached.withColumn("rank", F.lit(top) + F.row_number().over(Window.orderBy(*place)))
        else:
            # Ranking a whole level needs one task; without a limit the level is rank enough, and edge_seq breaks ties.
            ranked = reached.withColumn("rank", F.lit(top + 1))
        seen = cut(seen.unionAll(ranked.select("id", F.lit(d).alias("distance"), F.col("rank").cast("long").alias("rank"), F.col("kind").alias("via"))))
    return seen


def region(nodes, edges, anchors, direction="both", kinds=(), depth=3, node_limit=None, edge_limit=None, per_file=None) -> tuple[DataFrame, DataFrame, int]:
    """Nodes with distance, edges in rank order with `edge_rank`, and the number of edges left out by edge_limit."""
    admitted = walk(nodes, edges, anchors, direction, kinds, depth, node_limit, per_file)
    allowed, known = edges.where(kind_is(F.col("kind"), kinds)), admitted.count()
    ends = [small(admitted.select(F.col("id").alias(end), F.col("distance").alias(f"{end}_distance"), F.col("rank").alias(f"{end}_rank")), known) for end in ("src", "dst")]
    inside = allowed.join(ends[0], "src").join(ends[1], "dst")
    found = lambda end, k: F.when((F.col(f"{end}_distance") < depth) & F.lit(direction != ("incoming", "outgoing")[k]), F.struct(F.col(f"{end}_rank").alias("a"), F.lit(k).alias("b"), F.col("edge_seq").alias("c")))
    inside = inside.withColumn("at", F.least(found("src", 0), found("dst", 1))).where(F.col("at").isNotNull())
    inside = inside.groupBy("src", "dst", "kind").agg(F.min("at").alias("at"), F.min_by("edge_seq", F.struct("at", "method")).alias("edge_seq"), F.min_by("method", F.struct("at", "method")).alias("method"), F.first("src_distance").alias("src_distance"), F.first("dst_distance").alias("dst_distance"))
    priority = F.when((F.col("src_distance") == 0) | (F.col("dst_distance") == 0), 0).otherwise(F.greatest("src_distance", "dst_distance"))
    inside = inside.withColumn("priority", priority)
    left_out = 0
    if edge_limit is not None:
        inside = cut(inside)
        left_out = max(0, inside.count() - edge_limit)
        inside = inside.orderBy("priority", "at", "kind", "src", "dst").limit(edge_limit).withColumn("edge_rank", F.row_number().over(Window.orderBy("priority", "at", "kind", "src", "dst")))
    return nodes.join(small(admitted, known), "id"), inside.drop("at"), left_out


def paths(edges: DataFrame, start: str, end: str, kinds=(), max_depth: int = DEFAULTS["depth"], max_paths: int = DEFAULTS["paths"]) -> DataFrame:
    """(path_rank, path, kinds): the first shortest paths along edges, in breadth-first order; parallel edges make paths of their own.

    Levels of nodes, a row each, grow from both ends, the smaller one next, until two meet. From the nodes in which they meet,
    only the edges that lie on shortest paths are kept. Paths then grow from the start along those, and since each
    beginning leads to the end, the first max_paths beginnings of a length hold all that is asked for.
    """
    spark = edges.sparkSession
    none = spark.createDataFrame([], "path_rank int, path array<string>, kinds array<string>")
    if start == end:
        return spark.createDataFrame([(1, [start], [])], none.schema)
    step = edges.where(kind_is(F.col("kind"), kinds)).select("src", "dst", "kind", "edge_seq")
    levels = {"src": [spark.createDataFrame([(start,)], "id string")], "dst": [spark.createDataFrame([(end,)], "id string")]}
    sizes = {"src": [1], "dst": [1]}
    meet = None
    while meet is None:
        if len(levels["src"]) + len(levels["dst"]) - 2 >= max_depth:
            return none
        here, there = ("src", "dst") if sizes["src"][-1] <= sizes["dst"][-1] else ("dst", "src")
        level = step.join(small(levels[here][-1].withColumnRenamed("id", here), sizes[here][-1]), here, "left_semi").select(F.col(there).alias("id")).distinct()
        for old, n in zip(levels[here], sizes[here], strict=True):
            level = level.join(small(old, n), "id", "left_anti")
        level = cut(level)
        if not (n := level.count()):
            return none
        levels[here].append(level)
        sizes[here].append(n)
        both = levels["src"][-1].join(small(levels["dst"][-1], sizes["dst"][-1]), "id", "left_semi")
        if both.limit(1).count():
            meet = cut(both)
    kept = {"src": [], "dst": []}
    for here, there in (("src", "dst"), ("dst", "src")):  # back to the start, on to the end
        alive, n = meet, min(sizes["src"][-1], sizes["dst"][-1])
        for old, m in zip(levels[here][-2::-1], sizes[here][-2::-1], strict=True):
            some = step.join(small(alive.withColumnRenamed("id", there), n), there, "left_semi").join(small(old.withColumnRenamed("id", here), m), here, "left_semi")
            some = cut(some)
            alive = some.select(F.col(here).alias("id")).distinct()
            n = m
            kept[here].append(some)
    found = spark.createDataFrame([(start, [start], [], [])], "src string, path array<string>, kinds array<string>, seqs array<long>")
    for some in [*kept["src"][::-1], *kept["dst"]]:
        grown = some.join(small(found, max_paths), "src").select(F.col("dst").alias("src"), F.concat("path", F.array("dst")).alias("path"), F.concat("kinds", F.array("kind")).alias("kinds"), F.concat("seqs", F.array("edge_seq")).alias("seqs"))
        found = grown.orderBy("seqs", "path", "kinds").limit(max_paths)
    return found.select(F.row_number().over(Window.orderBy("seqs", "path", "kinds")).alias("path_rank"), "path", "kinds")


def impact(nodes, edges, anchor: DataFrame, max_depth=DEFAULTS["depth"], max_nodes: int | None = DEFAULTS["nodes"], kinds=REFERENCE_KINDS) -> tuple[DataFrame, DataFrame]:
    """What depends on an anchor: nodes with distance and the kind of edge they were found by, and the edges among them, each once."""
    seen = walk(nodes, edges, anchor, "incoming", kinds, max_depth, max_nodes)
    known = seen.count()
    ends = [small(seen.select(F.col("id").alias(end), F.col("distance").alias(f"{end}_distance")), known) for end in ("src", "dst")]
    inside = edges.where(kind_is(F.col("kind"), kinds)).join(ends[0], "src").join(ends[1], "dst").where(F.col("dst_distance") < max_depth)
    return nodes.join(small(seen, known), "id"), subgraph_edges(inside).drop("src_distance", "dst_distance")


def expand(nodes, edges, start: DataFrame, max_depth: int, kinds=(), containment=False, max_nodes: int | None = None) -> DataFrame:
    """Nodes with distance around some, in both directions over chosen kinds and, if asked for, containment."""
    wanted = (*kinds, *(CONTAINMENT_KINDS if containment else ()))
    return nodes.join(walk(nodes, edges, start, "both", wanted, max_depth, max_nodes), "id")


def locate(nodes, edges, start):
    return expand(nodes, edges, start, 1, ("import", "inherit", "implement"), True, 50)


def flow(nodes, edges, start):
    return expand(nodes, edges, start, 3, ("call", "instantiate"), False, 70)


def impacted(nodes, edges, start):
    """Reverse walk over all kinds, containment too."""
    return nodes.join(walk(nodes, edges, start, "incoming", (), 3, 60), "id")


def flow_between(edges: DataFrame, anchors: list[str], kinds=FLOW_KINDS, depth: int = DEFAULTS["depth"]) -> DataFrame:
    """(flow_rank, path, kinds): the first shortest path of each ordered pair of anchors, without those that run inside another, each once."""
    found = [paths(edges, a, b, kinds, depth, 1).select(F.lit(i).alias("flow_rank"), "path", "kinds") for i, (a, b) in enumerate((a, b) for a in anchors for b in anchors if a != b)]
    if not found:
        return paths(edges.limit(0), "", "-").select(F.col("path_rank").alias("flow_rank"), "path", "kinds")
    every = reduce(DataFrame.unionAll, found).groupBy("path").agg(F.min("flow_rank").alias("flow_rank"), F.min_by("kinds", "flow_rank").alias("kinds"))
    every = cut(every.withColumn("text", F.concat(F.lit("\x01"), F.array_join("path", "\x01"), F.lit("\x01"))))
    other = F.broadcast(every.select(F.col("text").alias("longer")))  # at most a path for each pair of anchors
    return every.join(other, (F.col("text") != F.col("longer")) & F.col("longer").contains(F.col("text")), "left_anti").select("flow_rank", "path", "kinds")


def blast_radius(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, show: int = 3) -> DataFrame:
    """(id, references, n_files, files, no_tests): incoming references, counted with parallels, and the files they come from."""
    incoming = edges.where(F.col("kind").isin(*REFERENCE_KINDS)).join(anchors.select(F.col("id").alias("dst")).distinct(), "dst")
    sources = incoming.join(nodes.select(F.col("id").alias("src"), F.col("path").alias("file")), "src", "left")
    by_file = sources.groupBy("dst", "file").agg(F.count("*").alias("n"), F.min("edge_seq").alias("first"))
    counted = by_file.groupBy("dst").agg(F.sum("n").alias("references"), F.count("file").alias("n_files"))
    shown = by_file.where(F.col("file").isNotNull()).withColumn("k", F.row_number().over(Window.partitionBy("dst").orderBy("first"))).where(F.col("k") <= show)
    shown = shown.groupBy("dst").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "file"))), lambda x: x["file"]).alias("shown"))
    counted = counted.join(shown, "dst", "left").withColumnRenamed("dst", "id")
    own = nodes.join(anchors.select("id").distinct(), "id", "left_semi").join(counted, "id", "left")
    more = F.when(F.col("n_files") > show, F.concat(F.lit(" +"), (F.col("n_files") - show).cast("string"), F.lit(" more"))).otherwise("")
    untested = F.col("kind").isin(*TESTABLE_KINDS) & ~F.coalesce("test_covered", F.lit(False)) if "test_covered" in nodes.columns else F.lit(None).cast("boolean")
    return own.select("id", F.coalesce("references", F.lit(0)).alias("references"), F.coalesce("n_files", F.lit(0)).alias("n_files"), F.concat(F.array_join(F.coalesce("shown", F.array().cast("array<string>")), ", "), F.coalesce(more, F.lit(""))).alias("files"), untested.alias("no_tests"))


def confidence(requested: Column, resolved: Column, flows: Column) -> Column:
    """Why an answer deserves little trust, if it does."""
    weak = (requested >= 2) & (resolved / requested < 0.5)
    return F.when(weak, "weak coverage").when((requested >= 2) & (resolved <= 1), "too thin").when((resolved >= 2) & (flows == 0), "no connections")


def bounded(requested: int | None, name: str) -> int:
    """A requested bound, or its default, within the policy's."""
    return min(DEFAULTS[name] if requested is None else requested, LIMITS[name])
