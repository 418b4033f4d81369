"""A training corpus from `documents` in five stages; each works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import mixing, ngramjoin, piece, quality, toxicity
from codestrata.llm.common import small_batches, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model (trained on the labels of other documents than fold 0) doesn't reject."""
    small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < 0.5).select(COLUMNS)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the fixed nor the learned rules reject."""
    small_batches(spark)
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.apply_rules(quality.measure(docs), rules).where("kept").select(COLUMNS)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row (that with the smallest id; of equal or no ids, the first) of each group of near duplicates. Rows are told apart by number, since ids may be null or repeat."""
    small_batches(spark)
    docs = stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")))
    grouped = stored(ngramjoin.groups(docs))
    first = grouped.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).select("first.row")
    out = stored(grouped.join(first, "row", "left_anti").select("row"))
    few = out.count() <= ngramjoin.BROADCAST_IDS
    return docs.join(F.broadcast(out) if few else out, "row", "left_anti").select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, in the order of its slots: sources are interleaved by their weights, small ones again and again until the largest is through."""
    small_batches(spark)
    return mixing.mix_sources(docs, ordered=int(spark.conf.get("spark.sql.shuffle.partitions"))).select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return piece.codec(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxic), ("quality rules", good), ("n-gram join", unlike), ("source mix", mixed), ("piece encoding", encoded)]

#: SQL can't express the stages; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
