"""What the operators of this subpackage share: reading, cutting lineage, byte-level words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The bytes that part words: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()

MUL, MUL_INV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Texts are long: batches of fewer rows than Spark's default of 10,000 keep Arrow's buffers outside the heap small. A setting that isn't the default stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from rows, which needs no Python worker."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * len(kinds), kinds, strict=True)], schema=kinds))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, as in local tests, a temporary one."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strata-"))
    return shared_dir(spark)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: later reads neither compute it again nor need the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    _stored.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_stored: list[str] = []


def clear(spark: SparkSession) -> int:
    """Removes the tables that were stored so far, when results that are read from them have been written; how many there were."""
    n = 0
    while _stored:
        n += removed(spark, _stored.pop())
    return n


def removed(spark: SparkSession, where: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let_go(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes stored tables that no later step reads, and what was shuffled for steps that have been stored: it stays on disk until the JVM finds that nothing refers to it."""
    for files in (t.inputFiles() for t in tables):
        for path in [p for p in _stored if files and f"/{p.rsplit('/', 1)[1]}/" in files[0]]:
            _stored.remove(path)
            removed(spark, path)
    spark.range(1).count()  # the last step's plan is held until another one runs
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Python workers live on between tasks; what they have freed goes back to the system, where libc can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text, so that numpy's arrays stay small; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes.astype(np.int64) + 64) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each starts (one more at the end). Null is empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and held.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word; words never cross from one text to the next. parts: the bytes that part words."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    word = ~parts[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the splitmix64 finisher)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MUL and its inverse to the powers 0 to n - 1, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max((1 << 20) + (1 << 17), n)
        for name, base in (("up", MUL), ("down", MUL_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, from one running sum over all bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
