"""Cutting the lineage of driver loops."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """df computed once (checkpoint() computes its last stage twice) and kept as a table in the checkpoint folder, which survives the loss of executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            folder = held.get()
        elif context.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="strata-")
            context.setCheckpointDir(folder)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{folder.rstrip('/')}/cut-{uuid.uuid4().hex}"
    _cuts.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffled(spark: SparkSession) -> Iterator[None]:
    """
    What is computed within joins by shuffles, except what is marked as broadcast. Left to itself Spark takes a side for small by its compressed files,
    or by a fixed length for texts that functions make, and sends tables to the driver that are many times larger. Lazy frames aren't bound by it: they need `hint("merge")`.
    """
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


_cuts: list[str] = []


def clear(spark: SparkSession) -> int:
    """Removes the tables that were cut off so far, when nothing is to be read from them any more; how many there were."""
    context = spark.sparkContext
    n = 0
    while _cuts:
        path = context._jvm.org.apache.hadoop.fs.Path(_cuts.pop())
        n += path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return n
