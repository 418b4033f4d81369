"""Op 1, approximate nearest neighbours by cross-polytope hashing.

A vector's direction goes through three rounds of random signs and a fast Hadamard transform; its bucket is
the nearest signed axis. Each of `tables` tables has its own signs. When a bucket would hold more than
`bucket_rows` points on average, a second, shorter cross-polytope (over 2, 4, 8, ... rotated coordinates)
refines it, so buckets keep their size as the table grows. A query looks into its `probes` nearest buckets in
each table (as many more for each doubling of the second polytope, so that recall doesn't fall as the table grows), ordered by
how much nearer the nearest axis is.

Equal vectors are one point, which is indexed, asked and answered once, however many rows have it. The tables hold codes: a byte
for each component, and its scale. In a bucket a query keeps the `spare` times k + 1 candidates that are nearest by their codes, then
those over all buckets; these are reranked by their exact distance on the original vectors, in double precision. A point's
k + 1 smallest ids stand for its rows (no more can be among anyone's nearest k, as ties go to the smaller id); each row with a query's
vector takes the point's answer without itself.

Points are dealt by (table, bucket, salt): a bucket of more than `salt_rows` points is cut into so many salted
parts, and its queries go to each part. A task streams its rows: queries of a bucket come first, candidates
follow in slices of bounded bytes, and only the best of each query and part leave the task.

Vectors that are null, zero, or hold null or non-finite components take no part. Vectors of different length
never meet. Rows that share an id are rows of their own, as queries and as candidates. A query with fewer candidates than it keeps
is compared with all points of its length, in blocks; fewer answers only where there are fewer others. Empty table: no rows. Queries are all rows with an id divisible by `every`; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

CELLS = 1 << 20  # distances, and components of each side, that are held at once


def matrix(column) -> np.ndarray:
    """Arrow lists of one length as rows."""
    values = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return values.to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def hadamard(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and Hadamard transform of unit rows, zeros added up to a power of two."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    signs = np.random.default_rng(seed).choice((-1.0, 1.0), size=(3, d))
    out = np.zeros((len(x), d))
    out[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    for s in signs:
        out = hadamard(out * s)
    return out


def axes(r: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Signed axes by nearness (2 * axis, plus 1 if negative), and how much farther each is than the first."""
    d = r.shape[1]
    both = np.empty((len(r), 2 * d))
    both[:, 0::2], both[:, 1::2] = r, -r
    probes = min(probes, 2 * d)
    top = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    value = np.take_along_axis(both, top, 1)
    order = np.lexsort((top, -value), axis=1)
    top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
    return top, (value[:, :1] - value) ** 2


def buckets(x: np.ndarray, seed: int, fine: int, probes: int) -> np.ndarray:
    """The `probes` nearest buckets of each row in one table; fine: coordinates of the second cross-polytope (0: none)."""
    first, far = axes(rotate(x, 2 * seed), probes)
    if not fine:
        return first
    second, far2 = axes(rotate(x, 2 * seed + 1)[:, :fine], probes)
    cost = (far[:, :, None] + far2[:, None, :]).reshape(len(x), -1)
    pair = (first[:, :, None] * (2 * fine) + second[:, None, :]).reshape(len(x), -1)
    return np.take_along_axis(pair, np.argsort(cost, axis=1, kind="stable")[:, :probes], 1)


def looked_at(probes: int, fine: int) -> int:
    """Buckets that a query looks into in one table: `probes`, and as many again for each doubling of the second polytope."""
    return probes * max(1, fine.bit_length())


def usable(vector: str = "vector"):
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return v.isNotNull() & F.coalesce(good, F.lit(False))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each component, and what it is worth."""
    scale = np.abs(x).max(1) / 127
    return np.round(x / scale[:, None]).astype(np.int8), scale


def decode(codes: pa.Array, scale: pa.Array) -> np.ndarray:
    width = len(codes[0].as_py())
    values = np.frombuffer(codes.buffers()[2], np.int8)[int(np.frombuffer(codes.buffers()[1], np.int32)[codes.offset]) :][: len(codes) * width]
    return values.reshape(len(codes), width).astype(np.float32) * scale.to_numpy(zero_copy_only=False).astype(np.float32)[:, None]


class Best:
    """The `keep` nearest candidates of each query so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, keep: int):
        self.ids, self.x, self.keep, self.square = ids, x, keep, (x * x).sum(1)
        self.far, self.near = np.zeros((len(ids), 0), np.float32), np.zeros((len(ids), 0), np.int64)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        step = max(1, CELLS // max(1, len(x) + self.keep))
        far, near = [], []
        for a in range(0, len(self.ids), step):
            own = slice(a, a + step)
            d = np.hstack((self.far[own], self.square[own, None] + (x * x).sum(1) - 2 * (self.x[own] @ x.T)))
            names = np.hstack((self.near[own], np.broadcast_to(ids, (len(d), len(ids)))))
            if d.shape[1] > self.keep:
                top = np.argpartition(d, self.keep - 1, axis=1)[:, : self.keep]
                d, names = np.take_along_axis(d, top, 1), np.take_along_axis(names, top, 1)
            far.append(d)
            near.append(names)
        self.far, self.near = np.concatenate(far), np.concatenate(near)

    def batch(self) -> pa.RecordBatch:
        n = self.far.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, n)), pa.array(self.near.ravel()), pa.array(self.far.ravel().astype(np.float32))], ["query", "point", "far"])


def meet(batches, keep: int):
    """(query, point, far) for rows in the order of (bucket, salt, asks first): each group's queries with their nearest candidates."""
    key, queries, best = None, [], None
    for whole in batches:
        rows = max(1, CELLS // max(1, whole.column("code")[0].as_buffer().size if whole.num_rows else 1))
        for batch in (whole.slice(a, min(rows, 4096)) for a in range(0, whole.num_rows, min(rows, 4096))):
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bucket", "salt", "asks")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                if tuple(keys[a, :2]) != key:
                    if best is not None:
                        yield best.batch()
                    key, queries, best = tuple(keys[a, :2]), [], None
                if keys[a, 2]:
                    queries.append((part.column("point").to_numpy(), decode(part.column("code"), part.column("scale"))))
                elif queries or best is not None:
                    if best is None:
                        best, queries = Best(np.concatenate([q[0] for q in queries]), np.concatenate([q[1] for q in queries]), keep), []
                    best.meet(part.column("point").to_numpy(), decode(part.column("code"), part.column("scale")))
    if best is not None:
        yield best.batch()


def search(vectors: DataFrame, every: int = 100, k: int = 10, tables: int = 8, probes: int = 16, bucket_rows: int = 4096, salt_rows: int = 65_536, spare: int = 4) -> DataFrame:
    """(query_id, rank, vec_id, score) for vectors(vec_id, vector: an array of float or double)."""
    spark, keep = vectors.sparkSession, spare * (k + 1)
    rows = vectors.where(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "vector", F.monotonically_increasing_id().alias("row"))
    rows = stored(rows)
    asks = F.col("vec_id") % every == 0
    # a point's number is that of its first row
    points = stored(rows.groupBy("vector").agg(F.min("row").alias("point"), F.max(asks).alias("asks")).withColumn("d", F.size("vector")))
    lengths = points.groupBy("d").count().collect()  # one row for each vector length
    fine_of = {}
    for d, n in lengths:
        axis = 1 << max(1, (d - 1).bit_length())
        fine, size = 0, 2 * axis
        while n / size > bucket_rows and fine < axis:
            fine = fine * 2 or 2
            size = 2 * axis * 2 * fine
        fine_of[d] = fine
    coded = "bucket long, asks boolean, point long, code binary, scale float"

    def run(batches, place):
        """place: (d, vectors, which ask) to (row, bucket, asks) arrays."""
        for whole in batches:
            for batch in (whole.slice(a, 1024) for a in range(0, whole.num_rows, 1024)):
                size = batch.column("d").to_numpy()
                for d in np.unique(size).tolist():
                    part = batch.filter(pa.array(size == d))
                    x = matrix(part.column("vector"))
                    code, scale = encode(x)
                    at, bucket, asking = place(d, x, part.column("asks").to_numpy(zero_copy_only=False))
                    take = pa.array(at)
                    codes = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * d).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(code))])
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(asking), part.column("point").take(take), codes.take(take), pa.array(scale.astype(np.float32)).take(take)], ["bucket", "asks", "point", "code", "scale"])

    def hashed(d, x, asking):
        at, keys, flags = [], [], []
        for q, wanted in ((False, 1), (True, looked_at(probes, fine_of[d]))):
            own = np.flatnonzero(asking) if q else np.arange(len(x))
            for t in range(tables if len(own) else 0):
                found = buckets(x[own], t, fine_of[d], wanted)
                at.append(np.repeat(own, found.shape[1]))
                keys.append((np.int64(d) << 40) + (np.int64(t) << 32) + found.ravel())
                flags.append(np.full(found.size, q))
        return np.concatenate(at), np.concatenate(keys), np.concatenate(flags)

    def plain(d, x, asking):
        return np.arange(len(x)), np.full(len(x), d, np.int64), asking

    index = lambda place: lambda batches: run(batches, place)

    def nearest(dealt: DataFrame) -> DataFrame:
        dealt = dealt.select("bucket", "asks", "point", "code", "scale", "salt").repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", F.desc("asks"))
        met = dealt.mapInArrow(lambda batches: meet(batches, keep), "query long, point long, far float").groupBy("query", "point").agg(F.min("far").alias("far"))
        return met.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("far", "point"))).where(F.col("n") <= keep).select("query", "point")

    indexed = stored(points.select("point", "vector", "asks", "d").mapInArrow(index(hashed), coded))
    # Only buckets that need salt, of which there are at most (indexed points / salt_rows).
    hot = indexed.where(~F.col("asks")).groupBy("bucket").count().where(F.col("count") > salt_rows).select("bucket", F.ceil(F.col("count") / salt_rows).cast("int").alias("salts"))
    dealt = indexed.join(F.broadcast(hot), "bucket", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    own = F.pmod(F.xxhash64("point"), F.col("salts")).cast("int")
    dealt = dealt.withColumn("salt", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(own)))).drop("salts")
    found = stored(nearest(dealt))

    sizes = spark.createDataFrame([tuple(r) for r in lengths], "d int, n long")  # one row for each vector length
    got = found.groupBy(F.col("query").alias("point")).agg(F.count("*").alias("found"))
    asking = points.where("asks").join(F.broadcast(sizes), "d").join(got, "point", "left")
    short = stored(asking.where(F.coalesce("found", F.lit(0)) < F.least(F.lit(keep), F.col("n"))).select("point", "vector", "d", F.lit(True).alias("asks")))
    counts = [tuple(r) for r in short.groupBy("d").count().collect()]
    if counts:  # each short query against all points of its length: points and queries are cut into parts, and each two parts meet once
        n_of = dict(lengths)
        cuts = F.broadcast(spark.createDataFrame([(d, -(-n_of[d] // salt_rows), -(-n // salt_rows)) for d, n in counts], "bucket long, p int, q int"))
        part = lambda c: F.pmod(F.xxhash64("point"), F.col(c)).cast("int")
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        flat = lambda df: df.select("point", "vector", "asks", "d").mapInArrow(index(plain), coded).join(cuts, "bucket")
        given = flat(points.withColumn("asks", F.lit(False)).where(F.col("d").isin([d for d, _ in counts]))).withColumn("own", part("p")).withColumn("other", each("q")).withColumn("salt", F.col("own") * F.col("q") + F.col("other"))
        asked = flat(short).withColumn("own", part("q")).withColumn("other", each("p")).withColumn("salt", F.col("other") * F.col("q") + F.col("own"))
        found = found.join(short.select(F.col("point").alias("query")), "query", "left_anti").unionByName(nearest(given.unionByName(asked)))

    def exact(batches):
        for whole in batches:
            for batch in (whole.slice(a, 1024) for a in range(0, whole.num_rows, 1024)):
                score = np.sqrt([((np.asarray(a, float) - np.asarray(b, float)) ** 2).sum() for a, b in zip(*(arrays(batch.column(c)) for c in ("vector", "other")), strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("point"), pa.array(score, pa.float64())], ["query", "point", "score"])

    pairs = found.join(points.select("point", F.col("vector").alias("other")), "point").join(points.select(F.col("point").alias("query"), "vector"), "query")
    scored = pairs.select("query", "point", "vector", "other").mapInArrow(exact, "query long, point long, score double")
    # the k + 1 smallest ids of each point, and the answers of each point that asks: its k + 1 nearest rows, itself among them
    named = rows.join(points.select("vector", "point"), "vector").select("point", "vec_id", "row")
    named = stored(named.withColumn("nth", F.row_number().over(Window.partitionBy("point").orderBy("vec_id", "row"))).where((F.col("nth") <= k + 1) | asks))
    answers = scored.join(named.where(F.col("nth") <= k + 1).select("point", "vec_id", "row"), "point")
    answers = answers.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id", "row"))).where(F.col("n") <= k + 1)
    answers = answers.groupBy(F.col("query").alias("point")).agg(F.sort_array(F.collect_list(F.struct("n", "score", "vec_id", "row"))).alias("answers"))  # k + 1 in each
    asked = named.where(asks).select("point", F.col("vec_id").alias("query_id"), F.col("row").alias("own")).join(answers, "point")
    others = F.slice(F.filter("answers", lambda x: x["row"] != F.col("own")), 1, k)
    return asked.select("query_id", F.posexplode(others).alias("place", "x")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def arrays(column: pa.Array) -> list[np.ndarray]:
    """Arrow lists as arrays."""
    at = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
    values = column.flatten().to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")))
