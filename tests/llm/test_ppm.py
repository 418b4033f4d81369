"""The language model against a plain version of it, over dictionaries."""

import collections
import math
import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("codestrata.llm")
from codestrata.llm import ppm  # noqa: E402

DOCS = "doc_id long, text string, n_tokens long"
STRIDE = 3


def tokens(t):
    return [w + b" " for w in "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()]


def parts_of(ws):
    """Words of a text cut where the operator cuts; the context of each part but the first."""
    cut = ppm.Words(pa.array([b"".join(ws).decode()]), STRIDE)
    at = cut.part.tolist()
    return [[w for w, p in zip(ws, at, strict=True) if p == k] for k in range(len(cut.part_text))]


class Plain:
    """Counts of bytes by context, and what being new costs."""

    def __init__(self, contexts):
        self.of, self.new, self.all = contexts, collections.Counter(), collections.Counter()
        for counts in contexts.values():
            total, kinds = sum(counts.values()), len(counts)
            for n in counts.values():
                if total > 1 and not (kinds == 1 and n == 1):
                    at = self.bucket(total - 1, kinds - (n == 1))
                    self.all[at] += n
                    self.new[at] += n == 1

    @staticmethod
    def bucket(total, kinds):
        return min(int(math.log2(total)), 20), min(int(2 * math.log2(kinds)), 16)

    def escape(self, counts):
        total, kinds = sum(counts.values()), len(counts)
        at = self.bucket(total, kinds)
        return (self.new[at] + 0.5) / (self.all[at] + 1) if self.all[at] else kinds / (total + kinds)


def code(byte, chain):
    """chain: (level, context) from long to short."""
    out, gone = 0.0, set()
    for level, context in chain:
        counts = level.of.get(context)
        if not counts:
            continue
        left = {b: n for b, n in counts.items() if b not in gone}
        if left:
            escape = level.escape(left)
            if byte in left:
                return out + math.log10((1 - escape) * left[byte] / sum(left.values()))
            out += math.log10(escape)
        gone = set(counts)
    return out - math.log10(256 - len(gone))


def plain(texts, training):
    docs = [tokens(t) for t in texts]
    train = [d for d, yes in zip(docs, training, strict=True) if yes]
    c = collections.Counter(w for d in train for w in d)
    counts = lambda: collections.defaultdict(collections.Counter)
    heads, root, trie = counts(), counts(), counts()
    first = lambda d: zip([b"  ", *((b" " + w[:-1])[-2:] for w in d)], [*(w[0] for w in d), 10], strict=True)
    for d in train:
        for before, byte in first(d):
            heads[before][byte] += 1
            root[b""][byte] += 1
    for w, n in c.items():
        for i in range(1, len(w)):
            trie[w[:i]][w[i]] += n
    shorter = [counts() for _ in range(3)]
    for h, found in trie.items():
        for byte in found:
            shorter[0][(b" " + h)[-2:]][byte] += 1
    for k in (1, 2):
        for h, found in shorter[k - 1].items():
            for byte in found:
                shorter[k][h[1:]][byte] += 1
    heads, root, trie, *shorter = map(Plain, (heads, root, trie, *shorter))
    head_cost = lambda before, byte: code(byte, [(heads, before), (root, b"")])
    rest = lambda w: sum(code(w[i], [(trie, w[:i]), *((s, (b" " + w[:i])[i - 1 :][k:]) for k, s in enumerate(shorter))]) for i in range(1, len(w)))
    segments, adapted = collections.defaultdict(collections.Counter), np.zeros((2, 3))
    own = []
    for d, yes in zip(docs, training, strict=True):
        parts, mine, before = parts_of(d), [], []
        for k, p in enumerate(parts):
            symbol = (tuple(p), k == len(parts) - 1)
            mine.append((tuple(before[-3:]), symbol) if k else None)
            before += p
        own.append((parts, mine))
        for x in mine:
            if x and yes:
                segments[x[0]][x[1]] += 1
    verdicts = []
    for d, yes in zip(docs, training, strict=True):
        seen, found = {}, []
        for i, w in enumerate(d):
            guesses = [seen.get(tuple(d[i - k : i])) if i >= k else None for k in (3, 2)]
            tried = [guesses[0] is not None, False, False]
            right = [guesses[0] == w, False, False]
            if guesses[0] != w and guesses[1] is not None and guesses[1] != guesses[0]:
                k = 1 if guesses[0] is None else 2
                tried[k], right[k] = True, guesses[1] == w
            found.append((tried, right))
            if yes:
                adapted += np.array([right, tried], float)
            for k in (3, 2):
                if i >= k:
                    seen[tuple(d[i - k : i])] = w
        verdicts.append(found)
    rate = (adapted[0] + 0.5) / (adapted[1] + 1)
    out = []
    for d, yes, (parts, mine), found in zip(docs, training, own, verdicts, strict=True):
        value, i = 0.0, 0
        starts = list(first(d))
        for k, p in enumerate(parts):
            lower = 0.0
            for w in p:
                tried, right = found[i]
                lower += sum(math.log10(rate[j] if right[j] else 1 - rate[j]) for j in range(3) if tried[j])
                if not any(right):
                    lower += head_cost(*starts[i]) + rest(w)
                i += 1
            if k == len(parts) - 1:
                lower += head_cost(*starts[-1])
            if mine[k]:
                context, symbol = mine[k]
                there = segments[context].copy()
                if yes:
                    there[symbol] -= sum(x == mine[k] for x in mine)
                there = +there
                total = sum(there.values()) + len(there)
                if there:
                    lower = math.log10(there[symbol] / total) if there[symbol] else lower + math.log10(len(there) / total)
            value += lower
        out.append(value)
    return out


def some_texts():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    write = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    out = [None, "", " \n", "a", "A b", "x" * 3000, write(3000), *(write(rng.randint(1, 60)) for _ in range(60))]
    out += [out[6], out[20], out[21][:-3], write(20) + " " + out[30], out[40] + " " + out[40], "日本語 中文 " * 5, "a b c " * 40, "a b c d"]
    return out


@pytest.mark.parametrize("options", [{"head": 10, "most": 20}, {"head": 0, "most": 3}, {}])
def test_score(spark, options):
    texts = some_texts()
    ids = [*range(len(texts) - 2), 3, None]
    training = [zlib.crc32(str("" if i is None else i).encode()) % 5 != 1 for i in ids]
    docs = spark.createDataFrame([(i, t, 0) for i, t in zip(ids, texts, strict=True)], DOCS).repartition(3)
    got = ppm.score(docs, STRIDE, **options).collect()
    want = sorted(((-1 if i is None else i), len(tokens(t)) + 1, not yes, round(x, 6)) for i, t, yes, x in zip(ids, texts, training, plain(texts, training), strict=True))
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.n_tokens, r.held_out, round(r.score, 6)) for r in got) == want


def test_nothing_to_learn_from(spark):
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    got = ppm.score(spark.createDataFrame([(held[0], "ab c", 0), (held[1], None, 0)], DOCS)).collect()
    assert sorted(round(r.score / math.log10(256), 6) for r in got) == [-6, -1]


def test_copies_and_order(spark):
    """Texts whose words come in the order of the training texts score better than shuffled ones, and a copied text better than one that stands alone."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    follow = {w: words[(17 * i + 5) % 400] for i, w in enumerate(words)}

    def chain(n):
        out = [rng.choice(words)]
        for _ in range(n - 1):
            out.append(follow[out[-1]])
        return out

    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1]
    texts = [chain(60) for _ in range(400)]
    mixed = {i: rng.sample(texts[i], 60) for i in held[::2]}
    rows = [(i, " ".join(mixed.get(i, t)), 0) for i, t in enumerate(texts)]
    alone = [i for i in range(400, 420) if zlib.crc32(str(i).encode()) % 5 != 1]
    twice = alone[::2]
    once = {i: " ".join(rng.choice(words) for _ in range(60)) for i in alone}
    rows += [(i, t, 0) for i, t in once.items()] + [(i, once[i], 0) for i in twice]
    got = collections.defaultdict(list)
    for r in ppm.score(spark.createDataFrame(rows, DOCS)).collect():
        got[r.doc_id].append(r.score)
    assert max(got[i][0] for i in mixed) < min(got[i][0] for i in held[1::2])
    assert max(got[i][0] for i in alone[1::2]) < min(min(got[i]) for i in twice)


def test_bytes_of_a_context_sum_to_one():
    """Whatever the context, the bytes' probabilities sum to one."""
    words = [f"w{i} ".encode() for i in range(60)]
    b = ppm.Beginnings(pa.array(words, pa.binary()))
    level = ppm.Level(*ppm.nodes(pa.array(words, pa.binary()), np.ones(60, np.int64), np.zeros(60, np.int64))[:4])
    keys, n = np.unique(b.two, return_counts=True)
    low = ppm.Low(keys, n)
    level.excludes(low.levels[0], b.two[np.unique(b.key, return_index=True)[1]])
    for before in (b"w", b"w1", b"w59", b"zz", b"q1"):
        asked = ppm.Beginnings(pa.array([before + bytes([x]) for x in range(256)], pa.binary()))
        mine = asked.depth == len(before)
        short = [asked.two[mine] & ((1 << bits) - 1) for bits in (24, 16, 8)]
        p = 10 ** ppm.log10_of([level, *low.levels], [asked.context[mine], *(k >> 8 for k in short)], [asked.key[mine], *short])
        assert len(p) == 256 and abs(p.sum() - 1) < 1e-9


@pytest.mark.parametrize("options", [{}, {"head": 10, "most": 20, "part": 150}])
def test_every_place_has_its_context(spark, monkeypatch, options):
    """By default each word that has three before it is predicted after these, and the end too, wherever they stand."""
    monkeypatch.setattr(sys.modules[__name__], "STRIDE", 1)
    assert [len(p) for p in parts_of(tokens("a b c d a b c e"))] == [3, 1, 1, 1, 1, 1, 0]
    texts = some_texts()
    training = [zlib.crc32(str(i).encode()) % 5 != 1 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], DOCS).repartition(3)
    got = ppm.score(docs, **options).collect()
    assert sorted((r.doc_id, round(r.score, 6)) for r in got) == sorted((i, round(x, 6)) for i, x in enumerate(plain(texts, training)))


def test_order_of_words_anywhere(spark):
    """Four words that follow each other somewhere in a training text cost less than these with another fourth, at whichever place of it they are."""
    rng = random.Random(8)
    words = rng.sample([a + b + c for a in "bcdfg" for b in "aeiou" for c in "klmnp"], 40)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1][:74]
    train = next(i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1)
    places = range(37)
    texts = {train: " ".join(words)} | {ids[2 * i]: " ".join(words[i : i + 4]) for i in places} | {ids[2 * i + 1]: " ".join([*words[i : i + 3], words[(i + 20) % 40]]) for i in places}
    got = {r.doc_id: r.score for r in ppm.score(spark.createDataFrame([(i, t, 0) for i, t in texts.items()], DOCS)).collect()}
    assert [i for i in places if got[ids[2 * i]] < got[ids[2 * i + 1]] + 1] == []
