"""Op 8, language-model scoring by prediction by partial matching (PPM), contexts from long to short.

A text is its lower-cased words and one end. What comes next is predicted in the longest context that is known; that a
context is wrong costs an escape, and what a longer one has ruled out isn't predicted again below it.

1. Words, pretrained: at every place the three words before are the context, wherever in a text it is; counts are those of the training
texts (method C escapes: as many as different words followed). The symbol is a segment: words are cut after every place where the hash of three words
in a row falls on a multiple of `stride`, so with the `stride` of 1 behind each of them, and a segment is one word (the last one runs up to the end of the
text). Of a training text's own occurrences of the segment at hand, none counts, so a text isn't predicted by itself, but by its copies.
2. Words, adaptive. Where the three (else the two) words before a word have stood in the same text already, the word that
followed them last is predicted; that it comes costs as much as hits and escapes of that context's length call for in the training texts.
3. Bytes, pretrained: a trie of contexts. A word is coded byte by byte, then a blank. The context of its first byte runs across the blank:
the last two bytes of the word before; below that, all words' first bytes. The context of any other byte is the
word so far, whatever its length, with counts of all training words; below that, the last two bytes, one, none, where a
byte counts once for each longer context that it was seen in (update exclusion). What stands below a context excludes the bytes seen in it. That a byte is new in a context
costs what contexts with so many occurrences and so many different bytes have turned out to cost when each of their
occurrences is left out in turn (a table of two logarithms for each length). Below the empty context all bytes are equal.

Counts are exact (words by 64 bits of a hash, contexts by 56, what follows a context by 26 more), from every training text, and alike at every size. They
stay on the executors: words are dealt by their beginnings, in families of at most `most` words, so that all longer contexts of a family meet in one
task; what is broadcast are contexts of two bytes with their bytes (2**24 at most), beginnings that more than `most` words share, and the `head` most
frequent words. Texts are packed into slices of some 1 MB. A slice asks for its different contexts with what follows them and for its other words, in the
order of their hashes and once each; what it asks is parted by ranges of these, each part answered by one task, and the answers, in the same order, meet the slice again.

Null and empty texts: one token, the end. Null ids count as ''. Repeated rows: a result for each. Empty table:
no rows. Without training texts all bytes are equal. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, MUL, give_back, let_go, mix, pieces, powers, small_batches, stored, table, text_bytes, word_hashes, word_spans

END = 10  # the byte that stands for the end of a text
BLANK = 32
#: Lengths of the beginnings by which words are dealt.
LADDER = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 1 << 10, 1 << 11, 1 << 12, 1 << 14, 1 << 16, 1 << 20, 1 << 30)
#: Kinds of adaptive contexts: three words; two, where three haven't been seen; two, where three were wrong.
KINDS = 3
WORD, HEAD, RATE, SEGMENT = range(4)
LOG_TOTAL, LOG_KINDS = 21, 17


def different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each different key once, in the order in which they come; where it comes first, and which of them each key is. By a hash table, without sorting."""
    found = pa.array(keys).dictionary_encode()
    which = found.indices.to_numpy().astype(np.int64)
    first = np.empty(len(found.dictionary), np.int64)
    first[which[::-1]] = np.arange(len(keys))[::-1]
    return found.dictionary.to_numpy(), first, which


def three_words(hashes: np.ndarray, text: np.ndarray, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Places whose k - 1 words before stand in the same text, and the hash of those k words."""
    j = np.flatnonzero(text[k - 1 :] == text[: len(text) - k + 1]) + k - 1
    key = text[j].astype(np.uint64) * np.uint64(0)
    for i in range(k):
        key = mix(key * MUL + hashes[j - i])
    return j, key


def predicted(hashes: np.ndarray, which: np.ndarray, text: np.ndarray, k: int) -> np.ndarray:
    """For each word, the one that followed the same k words before in the same text, the last time; else -1."""
    out = np.full(len(which), -1)
    if len(which) <= k:
        return out
    j, key = three_words(hashes, text, k)
    j = j + 1
    inside = j < len(text)
    inside[inside] = text[j[inside]] == text[j[inside] - 1]
    j, key = j[inside], mix(key[inside] * MUL + text[j[inside]].astype(np.uint64))
    order = np.argsort(key)  # not by place among equals; few contexts come again, and those are put in order
    same = key[order][1:] == key[order][:-1]
    inside = np.append(same, False) | np.append(False, same)
    group, place = np.cumsum(np.append(True, ~same))[: len(key)][inside], order[inside]
    by = np.lexsort((place, group))
    group, place = group[by], place[by]
    again = np.flatnonzero(group[1:] == group[:-1])
    out[j[place[again + 1]]] = which[j[place[again]]]
    return out


def adaptive(hashes: np.ndarray, which: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word and kind of context whether it predicts (rows of the first), and whether it is right (of the second)."""
    three, two = predicted(hashes, which, text, 3), predicted(hashes, which, text, 2)
    hit = three == which
    again = ~hit & (two >= 0) & (two != three)
    tried = np.stack([three >= 0, again & (three < 0), again & (three >= 0)])
    return tried, tried & np.stack([hit, two == which, two == which])


class Words:
    """The words of a batch of texts, and the parts that they are cut into."""

    def __init__(self, column: pa.Array, stride: int):
        data, at = text_bytes(column)
        self.data = LOWER[data]
        self.starts, self.ends, self.text = word_spans(self.data, at)
        self.texts = n = len(at) - 1
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        _, self.first, self.which = different(self.hashes)
        words = np.searchsorted(self.text, np.arange(n + 1))  # of each text the first; one more
        j, key = three_words(self.hashes, self.text) if len(self.hashes) > 2 else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        cut = (key >> np.uint64(40)) % np.uint64(stride) == 0
        j, key = j[cut], key[cut]
        base = np.arange(n + 1) + np.searchsorted(j, words)  # of each text the first part; one more
        cuts = self.text[j] + np.arange(1, len(j) + 1)  # the parts that begin behind a cut
        begin = np.empty(base[-1], np.int64)
        begin[base[:-1]], begin[cuts] = words[:-1], j + 1
        self.part_text = np.repeat(np.arange(n), np.diff(base))
        self.number = np.arange(base[-1]) - base[self.part_text]
        last = np.zeros(base[-1], bool)
        last[base[1:] - 1] = True
        end = np.where(last, words[self.part_text + 1], np.append(begin[1:], 0))
        self.part = np.repeat(np.arange(base[-1]), end - begin)
        self.last_part = base[1:] - 1
        up, down = powers(len(self.hashes) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hashes * up[: len(self.hashes)], dtype=np.uint64)))
        segment = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)) ^ np.where(last, MUL, np.uint64(0))
        self.inner = cuts  # parts that have a context
        self.context = key
        self.segment = mix(key * MUL + segment[cuts])

    def heads(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(last two bytes before, byte) of each word's first byte and of each text's end, as numbers; the texts of the words' and of the ends'."""
        ends = np.searchsorted(self.text, np.arange(self.texts + 1))
        before = np.full(len(self.starts) + 1, BLANK << 8 | BLANK, np.int64)  # of each word: what ends the word before
        if len(self.starts):
            y = self.data[self.ends - 1].astype(np.int64)
            x = np.where(self.ends - self.starts > 1, self.data[np.maximum(self.ends - 2, 0)], BLANK).astype(np.int64)
            before[1:] = x << 8 | y
        closing = np.where(np.diff(ends) > 0, before[ends[1:]], BLANK << 8 | BLANK)
        opening = before[:-1].copy()
        opening[ends[:-1][np.diff(ends) > 0]] = BLANK << 8 | BLANK
        return opening << 8 | self.data[self.starts].astype(np.int64), closing << 8 | END, opening

    def spans(self, words: np.ndarray) -> pa.Array:
        """Bytes of some words, a blank behind each."""
        size = self.ends[words] - self.starts[words] + 1
        to = np.concatenate(([0], np.cumsum(size)))
        inside = np.arange(to[-1]) - np.repeat(to[:-1], size)
        out = self.data[np.minimum(np.repeat(self.starts[words], size) + inside, max(0, len(self.data) - 1))] if len(words) else np.zeros(0, np.uint8)
        out[to[1:] - 1] = BLANK
        return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(out)])


SLICE = "g long, held binary"


def slices(docs: DataFrame, most: int = 1 << 20) -> DataFrame:
    """docs(doc_id, text, training) in rows of about `most` bytes of text, each with a number of its own; a longer text has one to itself."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        size, g = 0, TaskContext.get().partitionId() << 32
        for batch in pieces(batches, most=most // 4):
            held.append(batch)
            size += (pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0) + 64 * batch.num_rows
            if size >= most:
                yield packed(g, held)
                held, size, g = [], 0, g + 1
        if held:
            yield packed(g, held)

    def packed(g, held):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3), use_threads=False)) as writer:
            for batch in held:
                writer.write_batch(batch)
        return pa.RecordBatch.from_arrays([pa.array([g]), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["g", "held"])

    return docs.select("doc_id", "text", "training").mapInArrow(run, SLICE)


def unpacked(held: pa.BinaryScalar, stride: int) -> tuple[pa.Table, Words, np.ndarray]:
    """A slice's rows, its words, and which of its texts are training texts."""
    rows = pa.ipc.open_stream(held.as_buffer(), options=pa.ipc.IpcReadOptions(use_threads=False)).read_all().combine_chunks()
    return rows, Words(rows.column("text").combine_chunks(), stride), rows.column("training").to_numpy().astype(bool)


COUNTS = "kind int, key long, word binary, c long, seen long"


def count(texts: DataFrame, stride: int, hold: int = 800_000) -> DataFrame:
    """Of slices: words with bytes, what first bytes follow, hits and tries of adaptive contexts: how often in training texts (c), words also in all (seen)."""

    def run(batches):
        held: dict[int, list] = {}
        size = 0
        for slice_ in (x for batch in batches for x in batch.column("held")):
            _, w, training = unpacked(slice_, stride)
            mine = training[w.text].astype(np.int64)
            c, seen = np.bincount(w.which, weights=mine, minlength=len(w.first)), np.bincount(w.which, minlength=len(w.first))
            held.setdefault(WORD, []).append((w.hashes[w.first], c, seen, w.spans(w.first)))
            opening, closing, _ = w.heads()
            held.setdefault(HEAD, []).append((*sums(np.concatenate((opening, closing)), np.concatenate((mine, training.astype(np.int64)))), None, None))
            tried, right = adaptive(w.hashes, w.which, w.text)
            held.setdefault(RATE, []).append((np.arange(KINDS), (right & training[w.text]).sum(1), (tried & training[w.text]).sum(1), None))
            size += len(w.first)
            if size > hold:
                yield from flush(held)
                held, size = {}, 0
        yield from flush(held)
        held.clear()
        give_back()

    def sums(key, n):
        keys, _, which = different(key)
        return keys, np.bincount(which, weights=n, minlength=len(keys))

    def flush(held):
        for kind, parts in held.items():
            keys, first, which = different(np.concatenate([p[0] for p in parts]))
            add = lambda k: np.bincount(which, weights=np.concatenate([p[k] for p in parts]), minlength=len(keys)).astype(np.int64) if parts[0][k] is not None else np.zeros(len(keys), np.int64)  # noqa: B023, E731
            words = pa.chunked_array([p[3] for p in parts]).take(pa.array(first)).combine_chunks() if parts[0][3] is not None else None
            c, seen = add(1), add(2)
            for i in range(0, len(keys), 1 << 16):
                at = slice(i, i + (1 << 16))
                m = len(keys[at])
                key = pa.nulls(m, pa.int64()) if words is not None else pa.array(keys[at].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), key, pa.nulls(m, pa.binary()) if words is None else words.slice(i, m), pa.array(c[at]), pa.array(seen[at])], [x.split()[0] for x in COUNTS.split(", ")])

    return texts.mapInArrow(run, COUNTS).groupBy("kind", "key", "word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def bucket(total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    log = lambda x, by, most: np.minimum((by * np.log2(np.maximum(x, 1))).astype(np.int64), most - 1)
    return log(total, 1, LOG_TOTAL) * LOG_KINDS + log(kinds, 2, LOG_KINDS)


def left_out(total: np.ndarray, kinds: np.ndarray, once: np.ndarray) -> np.ndarray:
    """Of contexts with each occurrence left out in turn: how often that was the byte's only one, and how often in all, by bucket. once: bytes that occur once."""
    out = np.zeros((2, LOG_TOTAL * LOG_KINDS))
    some = total > 1
    t, k, s = total[some], kinds[some], once[some]
    new, old = bucket(t - 1, k - 1), bucket(t - 1, k)
    lone = k > 1  # with no other byte left there is no context
    for row, at, n in ((0, new[lone], s[lone]), (1, new[lone], s[lone]), (1, old, t - s)):
        out[row] += np.bincount(at, weights=n, minlength=out.shape[1])
    return out


def find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key is, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


class Level:
    """Contexts of one length: their bytes with counts, totals, numbers of different bytes, and what they exclude one level below."""

    def __init__(self, context: np.ndarray, byte: np.ndarray, counts: np.ndarray, key: np.ndarray):
        order = np.argsort(key)
        self.keys, self.counts, self.byte = key[order], counts[order].astype(float), byte[order]
        self.contexts, self.of = np.unique(context[order], return_inverse=True)
        add = lambda x: np.bincount(self.of, weights=x, minlength=len(self.contexts)).astype(float)
        self.total, self.kinds, self.once = add(self.counts), add(np.ones(len(self.of))), add((self.counts == 1).astype(float))
        self.excluded = np.zeros(len(self.contexts))
        self.seen = left_out(self.total, self.kinds, self.once)

    def excludes(self, below: Level, key_below: np.ndarray) -> Level:
        """key_below: the keys that this level's bytes, in the order of `keys`, have one level below."""
        at, _ = find(below.keys, key_below)
        self.excluded = np.bincount(self.of, weights=below.counts[at] if len(at) else [], minlength=len(self.contexts)).astype(float)
        return self

    def escape(self, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        at = bucket(total, kinds)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.seen[1][at] > 0, (self.seen[0][at] + 0.5) / (self.seen[1][at] + 1), kinds / (total + kinds))


def log10_of(levels: list[Level], contexts: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """log10 of each byte's probability, in levels from long to short; contexts, keys: in each level."""
    n = len(keys[0])
    out, gone, gone_kinds, live = np.zeros(n), np.zeros(n), np.zeros(n), np.arange(n)
    for level, context, key in zip(levels, contexts, keys, strict=True):
        c, known = find(level.contexts, context[live])
        at, c, passed = live[known], c[known], live[~known]
        total, kinds = level.total[c] - gone[at], level.kinds[c] - gone_kinds[at]
        e, hit = find(level.keys, key[at])
        escape = level.escape(total, kinds)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[at] += np.where(hit, np.log10((1 - escape) * level.counts[e] / total) if len(level.counts) else 0, np.where(kinds > 0, np.log10(escape), 0))
        gone[at], gone_kinds[at] = level.excluded[c], level.kinds[c]
        live = np.concatenate((at[~hit], passed))
    out[live] -= np.log10(256 - gone_kinds[live])
    return out


class Low:
    """Contexts of two bytes, one and none below the words' beginnings. keys: two bytes and the byte, with the number of beginnings that have it."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        two = Level(keys >> 8, keys & 255, counts, keys)
        levels = [two]
        for bits in (16, 8):
            up = levels[-1]
            below, n = np.unique(up.keys & ((1 << bits) - 1), return_counts=True)
            levels.append(Level(below >> 8, below & 255, n, below))
            up.excludes(levels[-1], up.keys & ((1 << bits) - 1))
        self.levels = levels


class Heads:
    """First bytes after the last two bytes of a word, and among all words. keys: two bytes and the byte."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        two = Level(keys >> 8, keys & 255, counts, keys)
        below, which = np.unique(keys & 255, return_inverse=True)
        root = Level(np.zeros(len(below), np.int64), below, np.bincount(which, weights=counts, minlength=len(below)), below)
        self.levels = [two.excludes(root, two.keys & 255), root]

    def log10(self, keys: np.ndarray) -> np.ndarray:
        return log10_of(self.levels, [keys >> 8, np.zeros(len(keys), np.int64)], [keys, keys & 255])


class Beginnings:
    """The bytes of words (each with a blank behind it) but their first: the hash of what is before each one in its word, its key there, the last two bytes and the byte, its depth and its word."""

    def __init__(self, column: pa.Array):
        data, at = text_bytes(column.cast(pa.large_binary()).view(pa.large_string()))
        size = np.diff(at)
        word = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(data))
        depth = place - at[word] if len(data) else place
        keep = depth > 0
        self.word, self.depth, place = word[keep], depth[keep], place[keep]
        self.byte = data[place].astype(np.int64)
        self.context = word_hashes(data, at[self.word], place)
        self.key = key_of(self.context, self.byte)
        before = np.where(self.depth > 1, data[np.maximum(place - 2, 0)], BLANK).astype(np.int64)
        self.two = (before << 8 | data[place - 1].astype(np.int64)) << 8 | self.byte


def key_of(context: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return mix(context * MUL + byte.astype(np.uint64) + np.uint64(1))


def nodes(words: pa.Array, c: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, ...]:
    """(context, byte, count, key, two) of the trie's nodes in which training words go on, from the depth `cut` of each word on."""
    held = []
    for i, some in in_turn(words):
        b = Beginnings(some)
        own = (c[i + b.word] > 0) & (b.depth >= cut[i + b.word])
        held.append((b.context[own], b.byte[own], c[i + b.word[own]], b.key[own], b.two[own]))
    context, byte, n, key, two = (np.concatenate(x) for x in zip(*held, strict=True))
    del held
    key, first, which = np.unique(key, return_index=True, return_inverse=True)
    return context[first], byte[first], np.bincount(which, weights=n, minlength=len(key)), key, two[first]


def in_turn(words: pa.Array, most: int = 1 << 15):
    """Some words at a time, so that numpy's arrays stay small; the number of the first of them."""
    for i in range(0, max(1, len(words)), most):
        yield i, words.slice(i, most)


def dealt(words: DataFrame, most: int) -> DataFrame:
    """words(word, c, seen) with `cut`, the length of the beginning that a family shares, and `bin`, whole families of about `most` words in all."""
    words = words.withColumn("cut", F.lit(LADDER[0]))
    for here, deeper in zip(LADDER, LADDER[1:], strict=False):
        crowded = stored(words.where(F.col("cut") == here).groupBy(F.substring("word", 1, here).alias("shared")).agg(F.count("*").alias("n")).where(F.col("n") > most).select("shared"))
        if crowded.limit(1).count() == 0:
            break
        # at most (number of words / most) rows
        found = words.join(F.broadcast(crowded), (F.col("cut") == here) & (F.substring("word", 1, here) == F.col("shared")), "left")
        words = found.withColumn("cut", F.when(F.col("shared").isNotNull(), deeper).otherwise(F.col("cut"))).drop("shared")
    bins = max(1, -(-2 * words.count() // most))
    return stored(words.withColumn("bin", F.pmod(F.xxhash64(F.expr("substring(word, 1, cut)")), F.lit(bins))))


def trained(words: DataFrame, most: int) -> DataFrame:
    """(key, c, seen, rest): log10 of the probability of a word's bytes after its first, for words(word, c, seen); key: the word's hash."""
    spark = words.sparkSession
    words = dealt(words, most)
    depth = F.explode(F.sequence(F.lit(1), F.least(F.col("cut"), F.length("word")) - 1))
    upper = words.where((F.col("c") > 0) & (F.least(F.col("cut"), F.length("word")) > 1)).select("word", "c", depth.alias("depth"))
    upper = upper.groupBy(F.expr("substring(word, 1, depth + 1)").alias("word")).agg(F.sum("c").alias("c")).toArrow()  # beginnings that words of several families share

    b = Beginnings(upper.column("word").combine_chunks().cast(pa.binary()) if upper.num_rows else pa.array([], pa.binary()))
    deepest = np.flatnonzero(np.append(b.word[1:] != b.word[:-1], True)) if len(b.word) else np.zeros(0, np.int64)
    top = b.context[deepest], b.byte[deepest], upper.column("c").to_numpy().astype(float), b.key[deepest], b.two[deepest]
    top_level = Level(*top[:4])

    def gather(whole: pa.Table) -> pa.Table:
        give_back()
        found = nodes(whole.column("word").combine_chunks(), whole.column("c").to_numpy(), whole.column("cut").to_numpy())
        two, n = np.unique(found[4], return_counts=True)
        seen = Level(*found[:4]).seen
        at = np.flatnonzero(seen[1])
        keys, counts = np.concatenate((two, -1 - 2 * at, -2 - 2 * at)), np.concatenate((n, seen[0][at], seen[1][at]))
        return pa.table({"two": pa.array(keys), "n": pa.array(counts.astype(np.float64))})

    sums = words.where("c > 0").select("bin", "word", "c", "cut").groupBy("bin").applyInArrow(gather, "two long, n double").groupBy("two").agg(F.sum("n").alias("n")).toArrow()  # at most 2**24 and the buckets
    two, n = sums.column("two").to_numpy(), sums.column("n").to_numpy()
    seen = top_level.seen.copy()
    for row in (0, 1):
        own = (two < 0) & ((-1 - two) % 2 == row)
        seen[row] += np.bincount((-1 - two[own]) // 2, weights=n[own], minlength=seen.shape[1])
    keys, which = np.unique(np.concatenate((two[two >= 0], top[4])), return_inverse=True)
    low = Low(keys, np.bincount(which, weights=np.concatenate((n[two >= 0], np.ones(len(top[4])))), minlength=len(keys)))
    spread = spark.sparkContext.broadcast((top, seen, low))

    def code(whole: pa.Table) -> pa.Table:
        give_back()
        top, seen, low = spread.value
        column = whole.column("word").combine_chunks()
        own = nodes(column, whole.column("c").to_numpy(), whole.column("cut").to_numpy())
        context, byte, counts, key, two = (np.concatenate(x) for x in zip(own, top, strict=True))
        level = Level(context, byte, counts, key)
        level.excludes(low.levels[0], two[np.argsort(key)])
        level.seen = seen
        del own, context, byte, counts, key, two
        names, costs = [], []
        for _, some in in_turn(column):
            b = Beginnings(some)
            short = [b.two & ((1 << bits) - 1) for bits in (24, 16, 8)]
            cost = log10_of([level, *low.levels], [b.context, *(k >> 8 for k in short)], [b.key, *short])
            data, at = text_bytes(some.cast(pa.large_binary()).view(pa.large_string()))
            names.append(word_hashes(data, at[:-1], at[1:] - 1).view(np.int64))
            costs.append(np.bincount(b.word, weights=cost, minlength=len(some)).astype(float))
        return pa.table({"key": pa.array(np.concatenate(names)), "c": whole.column("c"), "seen": whole.column("seen"), "rest": pa.array(np.concatenate(costs))})

    out = stored(words.select("bin", "word", "c", "seen", "cut").groupBy("bin").applyInArrow(code, "key long, c long, seen long, rest double"))
    let_go(spark, words)
    return out


#: Of hashes, 56 bits tell contexts apart (among 10**10 contexts one in seven million has another's bits), and 26 bits what follows one.
CONTEXT_BITS, FOLLOW_BITS = np.uint64(2**64 - 2**8), np.uint32(2**32 - 2**6)
ASKED = "p long, g long, kind int, m long, steps binary, follows binary, times binary"
ANSWERS = "g long, kind int, p long, m long, found binary"


def sorted_pairs(contexts: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of contexts and, after equal ones, of what follows (32 bits); where in it contexts begin, and where pairs do."""
    order = np.argsort(contexts)  # equal ones in any order; few contexts come again, and those are put in order
    new = np.ones(len(order), bool)
    new[1:] = contexts[order[1:]] != contexts[order[:-1]]
    alone = new & np.append(new[1:], True)
    some = np.flatnonzero(~alone)
    pair = (np.cumsum(new[some]).astype(np.uint64) << np.uint64(32)) | follows[order[some]].astype(np.uint64)
    by = np.argsort(pair)
    order[some], pair = order[some[by]], pair[by]
    both = np.ones(len(order), bool)
    both[some[1:]] = pair[1:] != pair[:-1]
    return order, new, both


def in_order(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A slice's different contexts with what follows them, in order; which of these each segment is."""
    contexts, follows = w.context & CONTEXT_BITS, (w.segment >> np.uint64(32)).astype(np.uint32) & FOLLOW_BITS
    order, _, both = sorted_pairs(contexts, follows)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(both) - 1
    return contexts[order[both]], follows[order[both]], which


def ranges(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of `parts` equal ranges of 64-bit keys have some of these, which are in order; where each begins (one more at the end)."""
    of = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    begin = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    return of[begin].astype(np.int64), np.append(begin, len(keys))


def small(values: np.ndarray) -> bytes:
    """Values as bytes, all first bytes first, then all second ones: those that are alike stand together."""
    return pa.compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes(), "zstd", asbytes=True)


def whole(held: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(pa.decompress(held, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n).T).view(kind).reshape(n)


def joined(rows: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([whole(x, m, kind) for x, m in zip(rows.column(name).to_pylist(), rows.column("m").to_pylist(), strict=True)])


def answer(asked: pa.Table, words: pa.Table) -> pa.Table:
    """What is known of all that slices ask in one range: of segments how often they, their contexts and how many different ones after these there are in training texts; of words their counts and costs."""
    give_back()
    out = []
    for kind in (SEGMENT, WORD):
        rows = asked.filter(pc.equal(asked.column("kind"), kind))
        if not rows.num_rows:
            continue
        sizes = rows.column("m").to_numpy()
        to = np.concatenate(([0], np.cumsum(sizes)))
        keys = np.concatenate([np.cumsum(whole(x, m, np.uint64), dtype=np.uint64) for x, m in zip(rows.column("steps").to_pylist(), sizes.tolist(), strict=True)])
        if kind == SEGMENT:
            order, new, both = sorted_pairs(keys, joined(rows, "follows", np.uint32))
            context, which = np.cumsum(new) - 1, np.cumsum(both) - 1
            n = joined(rows, "times", np.int32)[order]
            c = np.bincount(which, weights=n).astype(np.int64)
            t, k = np.bincount(context, weights=n).astype(np.int64), np.bincount(context[both], weights=c > 0).astype(np.int64)
            found = [np.empty(len(keys), np.int64) for _ in range(3)]
            for x, y in zip(found, (c[which], t[context], k[context]), strict=True):
                x[order] = y
        else:
            by = np.argsort(words.column("key").to_numpy().view(np.uint64))
            at, known = find(words.column("key").to_numpy().view(np.uint64)[by], keys)
            found = [np.where(known, words.column(x).to_numpy()[by][at], 0) if len(by) else np.zeros(len(keys)) for x in ("c", "rest")]
            found = [found[0].astype(np.int64), found[1].astype(float)]
        blobs = [small(np.concatenate([x[i:j].view(np.int64) for x in found])) for i, j in zip(to, to[1:], strict=False)]
        out.append(pa.table([rows.column("g"), rows.column("kind"), rows.column("p"), pa.array(sizes), pa.array(blobs, pa.binary())], [x.split()[0] for x in ANSWERS.split(", ")]))
    return pa.concat_tables(out) if out else pa.table({x: pa.array([], t) for x, t in zip(("g", "kind", "p", "m", "found"), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)})


def answered(found: pa.Table, kind: int, kinds: list[type]) -> list[np.ndarray]:
    """A slice's answers in the order in which it asked."""
    rows = found.filter(pc.equal(found.column("kind"), kind)).sort_by("p")
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for m, blob in zip(rows.column("m").to_pylist(), rows.column("found").to_pylist(), strict=True):
        for held, values, dtype in zip(out, whole(blob, m * len(kinds), np.int64).reshape(len(kinds), m), kinds, strict=True):
            held.append(values.view(dtype))
    return [np.concatenate([np.zeros(0, dtype), *held]) for held, dtype in zip(out, kinds, strict=True)]


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, stride: int = 1, head: int = 1 << 18, most: int = 200_000, part: int = 1_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs(doc_id, text). part: about how many words' contexts one task answers."""
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5))
    texts = stored(slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold != 1).alias("training"))))
    counted = stored(count(texts, stride))
    few = counted.where(F.col("kind").isin(HEAD, RATE)).select("kind", "key", "c", "seen").toArrow()  # at most 2**24 and KINDS rows
    kind, key, c = (few.column(x).to_numpy() for x in ("kind", "key", "c"))
    rate = dict(zip(key[kind == RATE].tolist(), zip(c[kind == RATE].tolist(), few.column("seen").to_numpy()[kind == RATE].tolist(), strict=True), strict=True))
    cost = np.log10([[1 - r, r] for r in ((rate.get(k, (0, 0))[0] + 0.5) / (rate.get(k, (0, 0))[1] + 1) for k in range(KINDS))])
    known = (kind == HEAD) & (c > 0)
    heads = Heads(key[known], c[known].astype(float))
    ends = int(c[(kind == HEAD) & (key & 255 == END)].sum())
    words = counted.where(F.col("kind") == WORD).select("word", "c", "seen")
    n, v, all_ = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum("seen"), F.lit(0))).first()
    parts = max(1, -(-all_ // part))
    n, v = n + ends, v + (ends > 0)
    total = n + 0.5 * (v + 1)
    end_base = math.log10((ends + 0.5) / total)
    coded = trained(words, most)
    let_go(spark, counted)
    frequent = coded.orderBy(F.desc("seen"), "key").limit(head).toArrow()
    by = np.argsort(frequent.column("key").to_numpy().view(np.uint64))
    head_b = spark.sparkContext.broadcast((heads, frequent.column("key").to_numpy().view(np.uint64)[by], frequent.column("c").to_numpy()[by], frequent.column("rest").to_numpy()[by]))  # `head` words

    def ask(batches):
        _, keys, _, _ = head_b.value
        for batch in batches:
            for g, held in zip(batch.column("g").to_pylist(), batch.column("held"), strict=True):
                _, w, training = unpacked(held, stride)
                contexts, follows, which = in_order(w)
                times = np.bincount(which, weights=training[w.part_text[w.inner]], minlength=len(contexts)).astype(np.int32)
                yield asked(g, SEGMENT, contexts, follows, times)
                own = w.hashes[w.first]
                yield asked(g, WORD, np.sort(own[~find(keys, own)[1]]), None, None)
        give_back()

    def asked(g, kind, *columns):
        p, at = ranges(columns[0], parts)
        steps = np.diff(columns[0], prepend=np.uint64(0))
        steps[at[:-1]] = columns[0][at[:-1]]
        blobs = [pa.nulls(len(p), pa.binary()) if x is None else pa.array([small(x[i:j]) for i, j in zip(at, at[1:], strict=False)], pa.binary()) for x in (steps, *columns[1:])]
        return pa.RecordBatch.from_arrays([pa.array(p), pa.array(np.full(len(p), g)), pa.array(np.full(len(p), kind, np.int32)), pa.array(np.diff(at)), *blobs], [x.split()[0] for x in ASKED.split(", ")])

    def add_up(slice_: pa.Table, found: pa.Table) -> pa.Table:
        heads, keys, c_head, rest_head = head_b.value
        rows, w, training = unpacked(slice_.column("held")[0], stride)
        own = w.hashes[w.first]  # each different word once
        at, frequent = find(keys, own)
        c, rest = (x[at] if len(x) else np.zeros(len(own), x.dtype) for x in (c_head, rest_head))
        rare = np.flatnonzero(~frequent)
        rare = rare[np.argsort(own[rare])]
        c[rare], rest[rare] = answered(found, WORD, [np.int64, float])
        opening, closing, _ = w.heads()
        tried, right = adaptive(w.hashes, w.which, w.text)
        starts, _, same = different(opening)
        lower = np.where(right.any(0), 0, heads.log10(starts)[same] + rest[w.which]) + sum(np.where(tried[k], cost[k][right[k].astype(int)], 0) for k in range(KINDS))
        value = np.bincount(w.part, weights=lower, minlength=len(w.part_text)).astype(float)
        value[w.last_part] += heads.log10(closing)
        _, _, which = in_order(w)
        here, there, kinds = (x[which] for x in answered(found, SEGMENT, [np.int64] * 3))
        text = w.part_text[w.inner]
        mine = training[text].astype(np.int64)
        again = np.flatnonzero(training[text] & (np.bincount(which)[which] > 1)) if len(which) else which
        _, _, same = different(which[again] * len(training) + text[again])
        mine[again] = np.bincount(same)[same] if len(same) else 0
        kinds = kinds - ((mine > 0) & (here == mine))
        here, there = here - mine, there - mine
        with np.errstate(divide="ignore", invalid="ignore"):
            value[w.inner] = np.where(there <= 0, value[w.inner], np.where(here > 0, np.log10(here / (there + kinds)), value[w.inner] + np.log10(kinds / (there + kinds))))
        m = len(training)
        sums = lambda of, x=None: np.bincount(of, weights=x, minlength=m)
        return pa.table({
            "doc_id": rows.column("doc_id"), "held_out": pa.array(~training), "n_tokens": pa.array(sums(w.text) + 1), "n_known": pa.array(sums(w.text, c[w.which] > 0).astype(np.int64) + (ends > 0)),
            "train_tokens": pa.array(np.full(m, n)), "base_score": pa.array(sums(w.text, np.log10((c + 0.5) / total)[w.which]) + end_base), "score": pa.array(sums(w.part_text, value)),
        })

    range_of = F.shiftright(F.shiftrightunsigned("key", 32) * F.lit(parts), 32)
    found = stored(texts.mapInArrow(ask, ASKED).groupBy("p").cogroup(coded.select(range_of.alias("p"), "key", "c", "rest").groupBy("p")).applyInArrow(answer, ANSWERS))
    let_go(spark, coded)
    return texts.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(add_up, SCORES)


def query(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return score(table(spark, sf_dir, "documents"))
