"""Debounced rebuilds: bursts of changes become one rebuild."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import EXCLUDED


def ignored(path: Column) -> Column:
    """Whether a segment of the path is hidden or among the excluded names."""
    return F.exists(F.split(F.translate(path, "\\", "/"), "/"), lambda p: F.lower(p).isin(*EXCLUDED) | p.startswith("."))


def sessions(changes: DataFrame, gap: str = "1 second", by: tuple[str, ...] = (), ts: str = "ts") -> DataFrame:
    """(by..., session_start, last_change, n): bursts of changes with less than `gap` between neighbours. Works on batches and, with a watermark, on streams."""
    grouped = changes.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"), F.max(ts).alias("last_change"))
    return grouped.select(*by, F.col("w.start").alias("session_start"), "last_change", "n")


def watch_and_rebuild(changes: DataFrame, rebuild: Callable[[], None], checkpoint: str, gap: str = "1 second", delay: str = "10 seconds", failed: Callable[[Exception], None] | None = None):
    """
    A streaming query over changes(path, ts) that calls rebuild() once for each micro-batch in which a burst has ended. Batches don't overlap, so
    neither do rebuilds. When rebuild raises, `failed` is told and the model before stays.
    """
    # Session windows on streams need a key: all changes are one project's.
    taken = changes.where(~ignored(F.col("path"))).withWatermark("ts", delay).withColumn("project", F.lit(0))
    bursts = sessions(taken, gap, ("project",))

    def on_batch(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            try:
                rebuild()
            except Exception as e:  # whatever goes wrong in a rebuild, the watcher goes on
                (failed or print)(e)

    return bursts.writeStream.outputMode("append").foreachBatch(on_batch).option("checkpointLocation", checkpoint).start()


def swap(tables: dict[str, DataFrame], prefix: str = "model") -> None:
    """Makes tables the ones that SQL sees from now on."""
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}_{name}")
