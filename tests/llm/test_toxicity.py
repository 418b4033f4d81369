"""The toxicity model against a plain version of it."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("codestrata.llm")
from codestrata.llm import toxicity  # noqa: E402

DOCS = "doc_id long, text string, score string"
BAD = ["vileword", "vilethings", "nastyone"]


def spoken(text):
    """Words of a text; a long one, or one of wide characters, from each of its characters on."""
    out = []
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", "".join(c.lower() if c.isascii() else c for c in text or "").encode()):
        long = len(w) > 15 or any(b >= 0xE0 for b in w)
        out += [w[i : i + 15] for i in range(len(w)) if w[i] & 0xC0 != 0x80] if long else [w]
    return out


def plain_weights(docs, least):
    """Of each beginning: the ratio of its last letter's probabilities in the two classes, and that of a letter that neither has after it."""
    counts = collections.defaultdict(lambda: [0, 0])
    for text, toxic in docs:
        for w in set(spoken(text)):
            for i in range(1, len(w) + 2):
                counts[(w + b" ")[:i]][1 - toxic] += 1
    counts = {b: n for b, n in counts.items() if sum(n) >= least}
    after = [collections.defaultdict(collections.Counter) for _ in range(4)]
    for b in counts:
        for k in range(min(3, len(b) - 1) + 1):
            after[k][b[len(b) - 1 - k : -1]][b[-1:]] += 1

    def shared(before, letter):
        p = 1 / (1 + max(1, len(after[0][b""])))
        for k in range(min(3, len(before)) + 1):
            found = after[k].get(before[len(before) - k :])
            if not found:
                break
            total = sum(found.values())
            p = max(found[letter] - 0.75, 0) / total + 0.75 * len(found) / total * p
        return p

    children = collections.defaultdict(dict)
    for b, n in counts.items():
        children[b[:-1]][b] = n

    def own(h, k):
        """Total of class k behind h, and what is left for letters it hasn't."""
        found = [n[k] for n in children[h].values()]
        return sum(found), 0.75 * sum(x > 0 for x in found) / sum(found) if sum(found) else 1.0

    out = {}
    for b in [b"", *counts]:
        edge = 0.0
        if b:
            p = []
            for k in (0, 1):
                total, left = own(b[:-1], k)
                p.append((max(counts[b][k] - 0.75, 0) / total if total else 0) + left * shared(b[:-1], b[-1:]))
            edge = math.log(p[0] / p[1])
        out[b] = (edge, math.log(own(b, 0)[1] / own(b, 1)[1]) if b in children else 0.0)
    return out


def plain_evidence(text, known):
    v = []
    for w in spoken(text):
        w, total = w + b" ", 0.0
        for i in range(1, len(w) + 1):
            if w[:i] not in known:
                total += known[w[: i - 1]][1]
                break
            total += known[w[:i]][0]
        v.append(total)
    if not v:
        return [0.0] * 4
    best = lambda k: max(sum(v[i : i + k]) / k for i in range(len(v) - k + 1)) if len(v) >= k else sum(v) / len(v)
    return [sum(v) / len(v), best(8), best(3), max(v)]


def some_texts():
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    write = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [write(rng.randint(1, 40)) + (f", {rng.choice(BAD)}! " + write(3) if i % 4 == 0 else "") for i in range(200)]
    return [*texts, None, "", "...", "x" * 40 + " vileword", "很坏的话很坏的话 " * 3, write(20_000) + " nastyone", texts[0], texts[0]]


@pytest.mark.parametrize("least", [1, 3])
def test_against_plain_version(spark, least):
    texts = some_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS)
    toxic = {i: int(i % 4 == 0) for i in range(200)}
    labels = spark.createDataFrame([(i, t) for i, t in toxic.items()] + [(7, 1), (None, 1), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs.repartition(3), labels, least=least)
    apart = {r.doc_id for r in docs.select("doc_id").where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(10)), F.lit(4)) == 0).collect()}
    training = [i for i in toxic if zlib.crc32(str(i).encode()) % 5 != 0 and i != 7]  # 7 has both labels
    known = plain_weights([(texts[i], toxic[i]) for i in training if i not in apart], least)
    want = np.array([plain_evidence(t, known) for t in texts])
    got = toxicity.evidence(pa.array(texts, pa.string()), model.table)
    assert np.allclose(got, want)
    # the curve is where the penalised likelihood of the documents kept apart is largest
    own = sorted(i for i in training if i in apart)
    x, y = np.hstack((want[own], np.ones((len(own), 1)))), np.array([toxic[i] for i in own])
    p = 1 / (1 + np.exp(-np.clip(x @ model.curve, -30, 30)))
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
    assert np.allclose(x.T @ (each * (y - p)) - np.array([1, 1, 1, 1, 1e-6]) * model.curve, 0, atol=1e-3)
    scored = {r.doc_id: r.score for r in toxicity.score(docs.repartition(4), model).collect()}
    assert np.allclose([scored[i] for i in range(len(texts))], 1 / (1 + np.exp(-np.clip(np.hstack((want, np.ones((len(want), 1)))) @ model.curve, -30, 30))))
    assert scored[203] > 0.5 and scored[205] > 0.5 and scored[206] == scored[207] == scored[0]


def test_edges(spark):
    """Null and repeated ids, an empty table, no labels, clashing columns."""
    texts = [f"plain words {i} here" + (" vileword" if i % 3 == 0 else "") for i in range(60)]
    rows = [(i if i % 10 else None, t, "x") for i, t in enumerate(texts)] + [(5, texts[3], "x"), (5, None, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, least=1)
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "text", "score"] and got.count() == 62
    assert {(r.text or "").endswith("vileword"): None for r in got.where("score >= 0.5").collect()} == {True: None}
    assert toxicity.score(docs.limit(0), model).count() == 0
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
