"""Op 2, mixing sources to target weights by Pfair scheduling.

Each source's rows, in a hashed order, are cut into blocks of `block_rows`. Weights are whole parts of `period`
slots (largest remainders). Block j of a source with a parts is released in slot floor(j * period / a) and due
by slot ceil((j + 1) * period / a); earliest deadline first fills one slot after the other. Release times and
deadlines of block j + a are those of block j plus one period, so the schedule of one period is found once
(`period` slots, whatever the data) and block j takes slot (j div a) * period + schedule[source, j mod a].
In every prefix each source then has less than one block more or fewer than its weight calls for, as long as
it has blocks.

A mix runs until each source has been used whole once: the slots of a source that ends sooner begin it again
(column `epoch` counts from 0), so no row is lost and the shares hold to the end. With `repeat=False` such
slots stay empty instead.

Null source is a source of its own. Sources without rows, or with weights given but not for them, get no slots. Empty table: no rows. Repeated rows
are rows like others. Every column of the input is kept; those named as the operator's own (block, epoch,
slot) are replaced. A period has a slot for each source at least; more sources than that are refused.
"""

from __future__ import annotations

import bisect
import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import local, stored, table


def whole_parts(weights: dict, period: int) -> dict:
    """Weights as whole parts that add up to period, at least one each (largest remainders)."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources need a period of as many slots at least")
    total = sum(map(Fraction, weights.values()))
    exact = {s: Fraction(w) / total * period for s, w in weights.items()}
    parts = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], str(s)))
    while (missing := period - sum(parts.values())) > 0:
        for s in order[:missing]:
            parts[s] += 1
    while (over := sum(parts.values()) - period) > 0:  # sources that were raised to one part
        for s in sorted(parts, key=lambda s: (exact[s] - parts[s], str(s)))[:over]:
            parts[s] -= parts[s] > 1
    return parts


def schedule(parts: dict) -> list[tuple[object, int]]:
    """(source, block) of each slot of a period: released blocks, earliest deadline first."""
    period = sum(parts.values())
    releases: dict[int, list] = {}
    for s, a in parts.items():
        for j in range(a):
            releases.setdefault(j * period // a, []).append((-(-(j + 1) * period // a), str(s), j, s))
    ready: list = []
    out = []
    for slot in range(period):
        for x in releases.get(slot, ()):
            heapq.heappush(ready, x[:3] + (x[3],))
        due, _, j, s = heapq.heappop(ready)
        assert due > slot, "a block missed its deadline"
        out.append((s, j))
    return out


#: Sources times buckets, and rows of a schedule, that are broadcast at most; beyond, joins shuffle.
BROADCAST_ROWS = 100_000
#: Rows' places (of 32 bytes) that are broadcast at most.
BROADCAST_PLACES = 1_000_000


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def places(rows: DataFrame, block_rows: int, buckets: int, sources: int) -> DataFrame:
    """rows(row, source, order) with `nth`, the row's place in its source. A source's rows are ranked in `buckets` hashed parts, so that a hot source isn't one task's."""
    keyed = rows.withColumn("bucket", F.pmod("order", F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = keyed.withColumn("r", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("order", "row")))
    joined = ranked.join(small(sizes, sources * buckets), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return joined.select("row", "source", (F.col("before") + F.col("r") - 1).alias("nth"))


def slots(rows: DataFrame, weights=None, period: int = 4096, block_rows: int = 16, repeat: bool = True, temper: float = 0.7, buckets: int = 64) -> DataFrame:
    """(row, block, epoch, slot) for rows(row, source, order): where and how often each row comes in the mix. order: a hash that says in which order a source's rows are used."""
    spark = rows.sparkSession
    empty = rows.select("row", F.lit(0).cast("long").alias("block"), F.lit(0).cast("int").alias("epoch"), F.lit(0).cast("long").alias("slot")).limit(0)
    most = max(period, len(weights or ()))
    found = rows.groupBy("source").count().orderBy(F.desc("count"), "source").limit(most + 1).collect()  # a period has a slot for each source
    counts = {r[0]: r[1] for r in found}
    weights = {s: (weights[s] if weights else n**temper) for s, n in counts.items() if not weights or weights.get(s, 0) > 0}
    if not weights:
        return empty
    parts = whole_parts(weights, most)
    period = sum(parts.values())
    blocks = {s: -(-counts[s] // block_rows) for s in parts}
    plan = schedule(parts)
    own: dict = {s: [] for s in parts}
    for slot, (s, _) in enumerate(plan):
        own[s].append(slot)
    # The slot in which the last source is through.
    end = 1 + max((blocks[s] - 1) // a * period + own[s][(blocks[s] - 1) % a] for s, a in parts.items())
    dealt = {s: end // period * a + bisect.bisect_left(own[s], end % period) for s, a in parts.items()}
    kind = rows.schema["source"].dataType.simpleString()
    place = local(spark, [(s, j, slot) for slot, (s, j) in enumerate(plan)], f"s {kind}, j long, at long")
    each = local(spark, [(s, a, blocks[s], -(-dealt[s] // blocks[s]) if repeat else 1) for s, a in parts.items()], f"s {kind}, a long, blocks long, epochs int")
    same = F.col("source").eqNullSafe(F.col("s"))
    out = places(rows, block_rows, buckets, len(counts)).withColumn("block", F.expr(f"nth div {block_rows}"))
    out = out.join(small(each, period), same).drop("s").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    out = out.withColumn("turn", F.col("block") + F.col("epoch") * F.col("blocks")).withColumns({"k": F.expr("turn % a"), "turn": F.expr("turn div a")})
    out = out.join(small(place, period), same & (F.col("k") == F.col("j"))).withColumn("slot", F.col("turn") * period + F.col("at"))
    return out.where(F.col("slot") < end).select("row", "block", "epoch", "slot")


def mix_sources(docs: DataFrame, weights=None, ordered: int = 0, **options) -> DataFrame:
    """Rows of docs with block, epoch and slot. weights: by source, sources without one are left out; without weights, each source's number of rows to the power `temper`.

    Only numbers are ranked and dealt; the rows themselves are joined to their places at the end. ordered: into so many partitions, by slot,
    with as many slots in each as in any other (0: in no order). options: those of slots().
    """
    names = [c for c in docs.columns if c.lower() not in ("block", "epoch", "slot")]
    kept = [F.col(f"`{c}`") for c in names]
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    # stored, so that a row has one number
    held = stored(docs.select(F.struct(*kept).alias("held"), F.monotonically_increasing_id().alias("row"), F.xxhash64(*hashed).alias("order")))
    found = stored(slots(held.select("row", F.col("held.source").alias("source"), "order"), weights, **options))
    rows, last = found.agg(F.count("*"), F.coalesce(F.max("slot"), F.lit(0))).first()
    mix = held.select("held", "row").join(F.broadcast(found) if rows <= BROADCAST_PLACES else found, "row")
    if ordered:
        mix = mix.repartitionById(ordered, F.expr(f"int(slot * {ordered} div {last + 1})")).sortWithinPartitions("slot", "row")
    return mix.select("held.*", "block", "epoch", "slot")


def query(spark, sf_dir: str) -> DataFrame:
    """Every document with its place in the mix: numbers only."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix_sources(docs).select("doc_id", "source", "block", "epoch", "slot")
