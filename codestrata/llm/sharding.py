"""Op 3, sharding: contiguous shards of near-equal bytes, cut from global prefix sums.

Rows are put in the order (hash of the text, doc_id), nulls first, so that equal texts stand together. Range partitioning gives each part
one run of that order; each part's total is one row, and the running sum of those totals (one row for each part) tells
every part where it begins. A group of equal texts goes whole to the shard in which the middle of its bytes lies. A group that is larger than
a TOGETHER-th of a shard is parted by rows, each by its own middle, and may reach over several parts; so each shard's
bytes differ from the target by at most that or the largest row. Only numbers and hashes are shuffled, never the texts.

Null text: 8 bytes, crc32 of the empty text. Empty table: no rows. Repeated rows are kept; equal rows are
dealt in an arbitrary but fixed order. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Groups of at most this part of a shard's bytes stay in one shard.
TOGETHER = 16


def shard_by_bytes(docs: DataFrame, shards: int = 24, parts: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("hash"), F.monotonically_increasing_id().alias("tie"))
    rows = stored(rows)
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # at most TOGETHER * shards groups
    crowded = rows.groupBy("hash").agg(F.sum("size").alias("own")).where(F.col("own") * (TOGETHER * shards) > total).select("hash", F.lit(True).alias("crowded"))
    rows = rows.join(F.broadcast(crowded), "hash", "left").withColumn("spread", F.when(F.col("crowded"), F.col("doc_id")))
    # Stored, since range bounds are sampled: totals and rows must see the same parts.
    rows = stored(rows.repartitionByRange(parts, "hash", "spread").withColumn("part", F.spark_partition_id()))
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    run = Window.partitionBy("part").orderBy("hash", "doc_id", "tie")
    size = F.sum("size")
    sums = rows.withColumns({"upto": size.over(run.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(run), "group_upto": size.over(Window.partitionBy("part").orderBy("hash")), "own": size.over(Window.partitionBy("part", "hash"))})
    twice = F.when(F.col("crowded"), 2 * F.col("upto") - F.col("size")).otherwise(2 * F.col("group_upto") - F.col("own"))
    placed = (
        sums.withColumn("twice", twice)
        .join(F.broadcast(bases), "part")  # one row for each part
        .withColumn("shard", F.least(F.expr(f"int((2 * base + twice) * {shards} div {max(1, 2 * total)})"), F.lit(shards - 1)))
        .withColumn("rank", F.col("first") + F.col("nth") - 1)
    )
    starts = placed.groupBy("shard").agg(F.min("rank").alias("start"))  # one row for each shard
    return placed.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("start")).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
