"""Op 10, toxicity: class-conditional Kneser-Ney models over the letters of words.

Each class (toxic, ordinary) has counts of word beginnings: how many different words with this beginning its
training documents have, document by document. The probability of the next letter after a beginning is the class's own count,
discounted, and for the rest a Kneser-Ney distribution over the last letters whose continuation counts are
shared by both classes; where neither class knows a beginning, both fall back to the same distribution and
its letters weigh nothing. A word's weight is the difference of its log-likelihoods in the two models. A
document's evidence is length-normalised: mean weight over the document, best mean over 8 words in a row,
best mean over 3 words, best word; a logistic curve, fitted on labelled rows kept apart from the counts, makes
it a score from 0 to 1. So a few abusive words in a long document are seen, and a rare word weighs little.

Training uses at most `most_labelled` labelled documents of each class (by the hash of their id, fold 0 of
crc32 mod 5 left out), whole; beginnings seen in fewer than `least` of them are left to the shared distribution.
labels, lang, source and doc_id are no inputs of a score. Every document is scored whole: words are parted at marks
outside ASCII too, and a run of more than 15 bytes, or of characters of three bytes and more (scripts that may have
no spaces), gives a word from each of its characters on, cut at 15 bytes, so whatever is in it is looked at from its own start.

Null and empty texts: evidence 0 in all parts. Without labels of both classes every score is 0. Documents with
conflicting labels don't train. Repeated rows: each its own result. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, MUL, mix, pieces, table, text_bytes, word_hashes, word_spans

#: Words are runs of ASCII letters and digits and of all other characters outside ASCII but marks.
PARTS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LONGEST = 16
DISCOUNT = 0.75


def marks(data: np.ndarray) -> np.ndarray:
    """data with blanks for marks and spaces outside ASCII: Latin-1's, U+2000 to U+206F, U+3000 to U+303F (but three that act as letters), full-width ASCII marks, U+FEFF."""
    out = data.copy()
    second, third = np.append(data[1:], 0)[: len(data)], np.append(data[2:], (0, 0))[: len(data)]
    two = (data == 0xC2) & ~np.isin(second, (0xAA, 0xB5, 0xBA))
    general = (data == 0xE2) & ((second == 0x80) | (second == 0x81) & (third < 0xB0))
    cjk = (data == 0xE3) & (second == 0x80) & ~np.isin(third, (0x85, 0x86, 0x87))
    wide = (data == 0xEF) & ((second == 0xBC) & ((third <= 0x8F) | (third >= 0x9A) & (third <= 0xA0) | (third >= 0xBB)) | (second == 0xBD) & ((third == 0x80) | (third >= 0x9B) & (third <= 0xA5)) | (second == 0xBB) & (third == 0xBF))
    three = general | cjk | wide
    for k, hit in ((0, two | three), (1, two | three), (2, three)):
        out[np.flatnonzero(hit) + k] = 32
    return out


def spread_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans with long runs and runs of wide characters replaced by spans of at most LONGEST - 1 bytes from each of their characters on."""
    if not len(starts):
        return starts, ends, text
    long = ends - starts > LONGEST - 1
    wide = np.concatenate(([0], np.cumsum(data >= 0xE0)))
    long |= wide[ends] > wide[starts]
    size = np.where(long, ends - starts, 1)
    run = np.repeat(np.arange(len(starts)), size)
    at = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size) + starts[run]
    keep = (at == starts[run]) | ((data[at] & 0xC0) != 0x80)  # not inside a character
    at, run = at[keep], run[keep]
    return at, np.where(long[run], np.minimum(at + LONGEST - 1, ends[run]), ends[run]), text[run]


def words_in(column: pa.Array):
    """Different lower-cased words of the texts (bytes, starts, ends), which of them each word is, and where each text's words start (one more at the end)."""
    data, at = text_bytes(column)
    data = marks(LOWER[data])
    starts, ends, text = spread_runs(data, *word_spans(data, at, PARTS))
    _, first, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return (data, starts[first], ends[first]), which, np.searchsorted(text, np.arange(len(at)))


def begun(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word's beginnings of 1, 2, ... letters (its end counts as a blank; no word is longer than LONGEST - 1), and how many there are."""
    length = np.minimum(ends - starts, LONGEST - 1)
    place = np.arange(LONGEST)
    letters = data[np.minimum(starts[:, None] + place, max(0, len(data) - 1))] if len(data) else np.zeros((len(starts), LONGEST), np.uint8)
    letters = np.where(place < length[:, None], letters, 32).astype(np.uint64)
    out, h = np.empty((len(starts), LONGEST), np.uint64), np.zeros(len(starts), np.uint64)
    for i in range(LONGEST):
        h = (h + letters[:, i] + np.uint64(1)) * MUL
        out[:, i] = mix(h + np.uint64(i))
    return out, length + 1


def beginnings(labelled: DataFrame) -> DataFrame:
    """(beginning, toxic, ordinary): documents of each class with a word that begins so; a word's end counts as a letter. labelled(text, toxic)."""

    def run(batches):
        held: dict[bytes, list[int]] = defaultdict(lambda: [0, 0])
        for batch in pieces(batches):
            (data, starts, ends), which, at = words_in(batch.column("text"))
            raw = data.tobytes()
            words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            for i, toxic in enumerate(batch.column("toxic").to_pylist()):
                for w in np.unique(which[at[i] : at[i + 1]]).tolist():
                    held[words[w]][toxic] += 1
            if len(held) > 500_000:
                yield flush(held)
        yield flush(held)

    def flush(held):
        sums: dict[bytes, list[int]] = defaultdict(lambda: [0, 0])
        for word, n in held.items():
            word = word + b" "
            for i in range(1, len(word) + 1):
                own = sums[word[:i]]
                own[0] += n[0]
                own[1] += n[1]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array([v[1] for v in sums.values()], pa.int64()), pa.array([v[0] for v in sums.values()], pa.int64())], ["beginning", "toxic", "ordinary"])

    counted = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "beginning binary, toxic long, ordinary long")
    return counted.groupBy("beginning").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


class Shared:
    """Kneser-Ney over the last letters, from how many different beginnings each sequence of letters ends."""

    def __init__(self, known: list[bytes], order: int = 3):
        self.order = order
        self.counts = [Counter() for _ in range(order + 1)]
        self.total = [Counter() for _ in range(order + 1)]
        self.kinds = [Counter() for _ in range(order + 1)]
        for b in known:
            for k in range(min(order, len(b) - 1) + 1):
                self.counts[k][b[len(b) - 1 - k :]] += 1
        for k, counts in enumerate(self.counts):
            for gram, n in counts.items():
                self.total[k][gram[:-1]] += n
                self.kinds[k][gram[:-1]] += 1
        self.letters = max(1, len(self.counts[0])) + 1

    def of(self, before: bytes, letter: bytes) -> float:
        p = 1 / self.letters
        for k in range(min(self.order, len(before)) + 1):
            h = before[len(before) - k :]
            if not (total := self.total[k].get(h)):
                break
            p = max(self.counts[k].get(h + letter, 0) - DISCOUNT, 0) / total + DISCOUNT * self.kinds[k][h] / total * p
        return p


def weights(rows: list[tuple[bytes, int, int]], totals: tuple[int, int]) -> dict[bytes, tuple[float, float]]:
    """For each known beginning, the log-likelihood ratio of its last letter, and that of any letter that neither class has after it."""
    rows = [(b"", *totals), *rows]
    shared = Shared([r[0] for r in rows if r[0]])
    sums, kinds = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for b, *n in rows:
        if b:
            for k in (0, 1):
                sums[b[:-1]][k] += n[k]
                kinds[b[:-1]][k] += n[k] > 0
    gap = {h: [DISCOUNT * kinds[h][k] / sums[h][k] if sums[h][k] else 1.0 for k in (0, 1)] for h in sums}
    out = {}
    for b, *n in rows:
        edge = 0.0
        if b:
            h = b[:-1]
            back = shared.of(h, b[-1:])
            p = [(max(n[k] - DISCOUNT, 0) / sums[h][k] if sums[h][k] else 0.0) + gap[h][k] * back for k in (0, 1)]
            edge = math.log(p[0] / p[1])
        out[b] = (edge, math.log(gap[b][0] / gap[b][1]) if b in gap else 0.0)
    return out


class Weights:
    """Weights of known beginnings, by hash: 24 bytes each."""

    def __init__(self, known: dict[bytes, tuple[float, float]]):
        self.root = known.get(b"", (0.0, 0.0))[1]
        by_length: list[list[bytes]] = [[] for _ in range(LONGEST + 1)]
        for b in known:
            by_length[len(b)].append(b)
        keys, values = [np.zeros(0, np.uint64)], [np.zeros((0, 2))]
        for n, same in enumerate(by_length):
            if n and same:
                data = np.frombuffer(b"".join(same), np.uint8)
                at = np.arange(len(same)) * n
                full = np.array([b[-1:] == b" " for b in same])
                # a beginning of n letters hashes as any word that starts with it; one that has its end, as itself
                hashes, _ = begun(data, at, at + np.where(full, n - 1, n))
                keys.append(hashes[:, n - 1])
                values.append(np.array([known[b] for b in same]))
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(keys)
        self.keys, self.edge, self.other = keys[order], values[order, 0], values[order, 1]

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each word's weight: along its beginnings, up to the first that isn't known."""
        hashes, n = begun(data, starts, ends)
        total, other = np.zeros(len(starts)), np.full(len(starts), self.root)
        live = np.arange(len(starts))
        for i in range(LONGEST if len(self.keys) else 0):
            live = live[n[live] > i]
            at = np.minimum(np.searchsorted(self.keys, hashes[live, i]), len(self.keys) - 1)
            hit = self.keys[at] == hashes[live, i]
            total[live[~hit]] += other[live[~hit]]
            live, at = live[hit], at[hit]
            total[live] += self.edge[at]
            other[live] = self.other[at]
        return total


EVIDENCE = ("whole", "eight", "three", "one")


def evidence(texts: pa.Array, table: Weights) -> np.ndarray:
    spans, which, at = words_in(texts)
    weight = table.of(*spans)[which]
    out = np.zeros((len(texts), len(EVIDENCE)))
    for i in np.flatnonzero(np.diff(at)):
        v = weight[at[i] : at[i + 1]]
        sums = np.concatenate(([0.0], np.cumsum(v)))
        out[i] = sums[-1] / len(v), *((sums[k:] - sums[:-k]).max() / k if len(v) >= k else sums[-1] / len(v) for k in (8, 3)), v.max()
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1.0) -> np.ndarray:
    """Coefficients of a logistic curve with an intercept, by Newton's method; both classes weigh alike."""
    a = np.hstack([x, np.ones((len(x), 1))])
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(a.shape[1])
    damp = ridge * np.eye(len(w))
    damp[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (each * p * (1 - p))[:, None]).T @ a + damp, a.T @ (each * (y - p)) - damp @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, table: Weights, curve: np.ndarray | None):
        self.table, self.curve = table, curve

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(texts))
        x = evidence(texts, self.table)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -30, 30)))


def fold(id_column, n: int = 5):
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 8_000, least: int = 3) -> Model:
    """A model from labels(doc_id, toxic) of documents outside fold 0; at most most_labelled of each class."""
    clear = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("t2")).where("toxic = t2 and toxic in (0, 1)")
    pick = lambda k: clear.where(F.col("toxic") == k).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    sample = pick(0).unionAll(pick(1))
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most twice most_labelled ids
    apart = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(10)), F.lit(4)) == 0  # for the curve
    counted = beginnings(labelled.where(~apart)).where(F.col("toxic") + F.col("ordinary") >= least)
    rows = [(b, t, o) for b, t, o in zip(*(c.to_pylist() for c in counted.toArrow().columns), strict=True)]
    first = [r for r in rows if len(r[0]) == 1]
    if not sum(r[1] for r in first) or not sum(r[2] for r in first):
        return Model(Weights({}), None)
    known = Weights(weights(rows, (sum(r[1] for r in first), sum(r[2] for r in first))))
    spread = docs.sparkSession.sparkContext.broadcast(known)  # bounded by the sample

    def run(batches):
        for batch in pieces(batches):
            x = evidence(batch.column("text"), spread.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *(pa.array(x[:, k]) for k in range(x.shape[1]))], ["doc_id", "toxic", *EVIDENCE])

    schema = ", ".join(["doc_id long", "toxic int", *(f"{c} double" for c in EVIDENCE)])
    seen = labelled.where(apart).select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, schema)
    x = seen.groupBy("doc_id", "toxic").agg(*(F.max(c).alias(c) for c in EVIDENCE)).orderBy("doc_id").toPandas()  # a row for each sampled id
    if x["toxic"].nunique() < 2:
        return Model(Weights({}), None)
    return Model(known, fit_curve(x[list(EVIDENCE)].to_numpy(float), x["toxic"].to_numpy()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score; a column of that name is replaced."""
    spread = docs.sparkSession.sparkContext.broadcast((model.table, model.curve))
    names = [c for c in docs.columns if c != "score"]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "score double"])

    def run(batches):
        own = Model(*spread.value)
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.score(batch.column("text")), pa.float64())], [*names, "score"])

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
