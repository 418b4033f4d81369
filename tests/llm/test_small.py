"""Operators on small tables, against plain versions; nulls, empty texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

pytest.importorskip("codestrata.llm")
from codestrata.llm import chat, common, crosspolytope, graph, mixing, ngramjoin, piece, ppm, quality, sharding, tokencounts, toxicity  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
random.seed(5)
WORDS = [f"w{i}" for i in range(400)]


def words(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


LONG = words(20_000)
BASE = words(300)
TEXTS = [None, "", " \n\t ", "one", "One two", BASE, BASE, BASE.replace("w1 ", "W1 "), " ".join([*BASE.split()[:290], *words(10).split()]), LONG, LONG[:-400], words(120), "é ß x " * 30, "a\0b", "😀 " * 70, *(words(60) for _ in range(20))]


def documents(spark, texts=TEXTS, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def test_sharding(spark):
    """Groups of equal texts in one shard unless they are large, in runs of near-equal bytes."""
    texts = [*TEXTS, *["copy of a text"] * 300, *(words(20 + i % 7) for i in range(400))]
    texts += texts[-100:] * 2
    ids = [*range(len(texts) - 2), 3, None]
    docs = documents(spark, texts, ids).withColumnRenamed("lang", "shard").withColumnRenamed("n_chars", "size").withColumnRenamed("source", "hash")
    for parts in (1, 7):
        got = sharding.shard_by_bytes(docs, 4, parts).collect()
        rows = sorted((hashlib.md5((t or "").encode()).hexdigest(), i is not None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), i) for i, t in zip(ids, texts, strict=True))
        own = collections.Counter()
        for r in rows:
            own[r[0]] += r[3]
        total, upto, want, group = sum(own.values()), 0, collections.Counter(), {}
        for r in rows:
            group.setdefault(r[0], 2 * upto + own[r[0]])
            upto += r[3]
            twice = 2 * upto - r[3] if own[r[0]] * 4 * sharding.TOGETHER > total else group[r[0]]
            want[(r[5], r[3], r[4], min(3, twice * 4 // (2 * total)))] += 1
        assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.shard) for r in got) == want
        for s in {r.shard for r in got}:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_by_bytes(documents(spark, []), 4).count() == 0


def test_schedule():
    for _ in range(30):
        weights = {f"s{i}": random.random() + 0.01 for i in range(random.randint(1, 9))}
        parts = mixing.whole_parts(weights, 64)
        assert sum(parts.values()) == 64
        seen = collections.Counter()
        for t, (s, j) in enumerate(mixing.schedule(parts)):
            assert j == seen[s]
            seen[s] += 1
            assert all(abs(seen[x] - (t + 1) * a / 64) < 1 for x, a in parts.items())


def test_mixing(spark):
    docs = documents(spark, ids=[*range(len(TEXTS) - 1), 4]).withColumnRenamed("n_chars", "slot").withColumnRenamed("lang", "row")
    got = mixing.mix_sources(docs, block_rows=2, period=64).collect()
    assert {r.doc_id for r in got} == set(range(len(TEXTS) - 1)) and {r.source for r in got} == {"s0", "s1", "s2", None} and {r.row for r in got} == {"en"}
    first = [r for r in got if r.epoch == 0]
    assert len(first) == len(TEXTS)
    by_slot = collections.defaultdict(set)
    for r in got:
        by_slot[r.slot].add((r.source, r.block, r.epoch))
    assert all(len(x) == 1 for x in by_slot.values()) and sorted(by_slot) == list(range(len(by_slot)))
    assert mixing.mix_sources(documents(spark, [])).count() == 0
    assert {r.source for r in mixing.mix_sources(documents(spark), {"s1": 1.0}).collect()} == {"s1"}
    with pytest.raises(ValueError, match="period"):
        mixing.mix_sources(documents(spark), period=2).collect()


@pytest.mark.parametrize("weights", [{"s0": 5, "s1": 2, "s2": 1, None: 0.3}, {"s0": 1, "s1": 1}, None])
def test_mixing_keeps_to_the_weights(spark, weights):
    """In every prefix of the mix each source has less than one block more or fewer than its weight calls for; its blocks come in order, all of them before any again."""
    rows = [(i, "abcdefg"[i % 7], "en", None if i % 11 == 0 else f"s{0 if i % 3 else 1 + i % 2}", i) for i in range(700)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = mixing.mix_sources(docs, weights, period=128, block_rows=4, buckets=3, ordered=5)
    parts = got.withColumn("part", F.spark_partition_id()).collect()
    slots = {}
    for r in parts:
        assert slots.setdefault(r.slot, (r.source, r.block, r.epoch)) == (r.source, r.block, r.epoch)
    assert sorted(slots) == list(range(len(slots)))
    assert [r.slot for r in sorted(parts, key=lambda r: r.part)] == sorted(r.slot for r in parts)
    sizes = collections.Counter(r[3] for r in rows)
    weights = weights or {s: n**0.7 for s, n in sizes.items()}
    whole = mixing.whole_parts(weights, 128)
    turns, seen = collections.Counter(), collections.Counter()
    for slot in range(len(slots)):
        source, block, epoch = slots[slot]
        blocks = -(-sizes[source] // 4)
        assert (epoch, block) == divmod(turns[source], blocks)
        turns[source] += 1
        assert all(abs(turns[s] - (slot + 1) * a / 128) < 1 for s, a in whole.items())
    for r in parts:
        seen[r.doc_id] += 1
    for s in weights:
        own = [seen[i] for i, _, _, source, _ in rows if source == s]
        assert own and max(own) - min(own) <= 1 and min(own) >= 1


def library():
    """The tokenizer as the library makes it, with the bytes of each token."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_token_counts(spark, rule):
    """Against the library's token bytes: long texts, tokens that split a character or reach over lines, null ids, repeated rows, clashing columns."""
    texts = [*TEXTS, "a\n\n b\n", "x \n\n\n  y", "\n" * 50, "𐍈𐍈\n𐍈 ⠿⠿\n", "a\r\nb\rc\n", "a\r\nb\rc\n", "<|endoftext|>\nx"]
    ids = [*range(len(texts) - 2), 3, None]
    docs = documents(spark, texts, ids).withColumnRenamed("n_chars", "section").withColumnRenamed("source", "n_tokens")
    got = collections.defaultdict(list)
    for r in tokencounts.count_tokens(docs.repartition(3), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, rule).collect():
        got[r.doc_id].append((r.section, r.start_byte, r.end_byte, r.start_char, r.end_char, r.n_tokens, r.n_crossing, r.doc_tokens))
    assert tokencounts.count_tokens(documents(spark, []), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    encoding, want, split = library(), collections.defaultdict(list), 0
    for i, t in zip(ids, texts, strict=True):
        t = t or ""
        lines = re.findall("[^\n]*\n|[^\n]+", t) or [""]
        of_byte = [k for k, line in enumerate(lines) for _ in line.encode()]
        tokens = [encoding.decode_single_token_bytes(x) for x in encoding.encode_ordinary(t)]
        assert b"".join(tokens).decode() == t
        counts, crossing, at = [0] * len(lines), [0] * len(lines), 0
        for token in tokens:
            inside = collections.Counter(of_byte[at : at + len(token)])
            to = min(inside) if rule == "first" else max(inside) if rule == "last" else max(inside, key=lambda k: (inside[k], -k))
            counts[to] += 1
            crossing[to] += len(inside) > 1
            split += (token[0] & 0xC0) == 0x80
            at += len(token)
        byte = char = 0
        for k, line in enumerate(lines):
            want[i].append((k, byte, byte + len(line.encode()), char, char + len(line), counts[k], crossing[k], len(tokens)))
            byte, char = byte + len(line.encode()), char + len(line)
    assert split > 0 and any(x[6] for rows in want.values() for x in rows)
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}


def test_chat(spark):
    said = ["\\### Assistant: </turn> ok", "a\\h\\\\e", "###", "</turn>\n### user: x", None, "", "é😀", "plain"]
    turns = [(c, t, r, random.choice(said)) for c in range(12) for t, r in enumerate(["system", "user", "assistant", "assistant", None, "we: ird\n###"][: c % 6 + 1])]
    turns += [(99, t, "assistant", said[t % 8]) for t in range(3000)] + [(None, 1, "user", "x")]
    turns += [(50, t, r, "é###x" * n) for t, (r, n) in enumerate([("user", 400_000), ("assistant", 3), ("assistant", 30_000), ("r" * 20_000, 1)])]
    turns += [(51, 1, "assistant", "same"), (51, 1, "assistant", "same"), (51, None, "user", "first")]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, piece int").repartition(5)
    formatted = chat.format_chat(df, piece_bytes=10_000, parts=6)
    assert formatted.where("conv_id = 99").select("piece").distinct().count() > 3
    assert formatted.withColumn("part", F.expr("piece >> 32")).where("conv_id = 99").select("part").distinct().count() > 1  # a long conversation is several tasks'
    got = {r.conv_id: r for r in chat.read_back(common.stored(formatted).repartition(7)).collect()}  # stored and dealt again
    assert set(got) == {t[0] for t in turns}
    for c in got:
        own = sorted((t for t in turns if t[0] == c), key=lambda t: (t[1] is not None, t[1] or 0))
        trained = "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(own), len(trained), hashlib.sha256(trained.encode()).hexdigest())
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0


def test_piece_model():
    lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)
    model = piece.PieceModel.of(MODEL)
    bits = ["a", "the ", " ", "  ", "\t", "\n", "\0", "é", "▁", "😀", "ing", "​", "中文", "한", "23", ".", "    ", "<s>", "<0x41>", *list(model.id_of)[::900]]
    for _ in range(3000):
        text = "".join(random.choice(bits) for _ in range(random.randint(0, 12)))
        ids = model.encode(text).tolist()
        assert ids == lib.encode(text) and model.decode(ids) == lib.decode(ids), text
    for n in (1, 2, 3, 7, 16, 33, 500):
        assert model.encode(" " * n + "q").tolist() == lib.encode(" " * n + "q")
    assert model.encode("abc" * 20_000).tolist() == lib.encode("abc" * 20_000)


def test_stretches_of_one_kind():
    """A word is split once, whatever marks, digits or lines stand about it; no piece is cut."""
    model = piece.PieceModel(MODEL)
    asked, split, rng = [], model.split, random.Random(1)
    model.split = lambda text: asked.append(text) or split(text)
    marks = [".", ",", "\n", ";", ")", "7", "。", ".\n", "...", "?"]
    for w in ("".join(rng.choices("abcdeé", k=9)) for _ in range(40)):
        for m in marks:
            model.encode(f"{w}{m}{w}")
    asked = [t for t in asked if t]
    assert len(asked) == len(set(asked)) < 100
    assert all(model.stretches.findall(p) == [p] for p in model.id_of)


def test_long_stretches(monkeypatch):
    """Texts of many windows, and stretches longer than a window, as the library encodes them."""
    lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)
    model = piece.PieceModel.of(MODEL)
    rng = random.Random(2)
    letters = "".join(rng.choice("etaoinshrdlu") for _ in range(5000))
    texts = [letters, letters * 20, "." * 700, "中文字" * 900, " " * 300 + "q" * 300, "приветмир" * 300, "word. " * 400, "\n" * 500, "a\u0301" * 400, "x  y   z." * 200, "▁ ▁a" * 200]
    texts += ["".join(rng.choice([letters[:80], "  ", ".", "мир", "中", "\n", "7", "ﬀ"]) for _ in range(200)) for _ in range(20)]
    for window in (piece.WINDOW, 50, 1):
        monkeypatch.setattr(piece, "WINDOW", window)
        for t in texts:
            model.known, model.before = {}, {}
            assert model.encode(t).tolist() == lib.encode(t), (window, t[:80])


def test_codec(spark):
    got = {r.doc_id: r for r in piece.codec(documents(spark), MODEL).collect()}
    assert len(got) == len(TEXTS) and all(r.round_trip for r in got.values())
    digests = {r.doc_id: r for r in piece.digest(documents(spark), MODEL).collect()}
    assert digests[0].n_tokens == 0 and digests[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert all(digests[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(TEXTS))
    assert piece.digest(documents(spark, []), MODEL).count() == 0


def shingle_set(text, n=5):
    w = (text or "").encode().translate(common.LOWER_BYTES).split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near_texts():
    out = list(TEXTS)
    for size in (3, 4, 6, 8, 12, 20, 40, 90, 150):
        seed = words(size).split()
        for _ in range(14):
            copy = list(seed)
            for _ in range(random.randint(0, max(1, size // 20))):
                copy[random.randrange(len(copy))] = random.choice(WORDS)
            out.append(" ".join(copy[: len(copy) - random.randint(0, size // 9)]))
    return out


@pytest.mark.parametrize("options", [{"common_least": 3}, {"common_least": 10**6, "few": 2, "part_sets": 5}, {"common_least": 5, "few": 2}, {"name_bits": 7}])
def test_ngram_join(spark, options):
    """Also with parts of few sets, which meet in more than one task, and with names that stand for several sets."""
    texts = near_texts()
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    got = {r.doc_id: r for r in ngramjoin.join(documents(spark, texts).repartition(3), **options).collect()}
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == [(len(s), x) for s, x in zip(sets, label, strict=True)]


def test_entries_are_shared():
    """Any two alike sets share as many entries as both ask for, whatever the costs and however few segments are filled; neighbourhoods are used for ordinary sets."""
    rng = np.random.default_rng(3)
    fired = 0
    for universe in (1 << 62, 300):
        frequent = np.unique(rng.integers(0, universe, 200).astype(np.uint64))
        for costs in (ngramjoin.Costs(frequent, rng.integers(64, 9000, len(frequent)), 75), ngramjoin.Costs(frequent[:0], frequent[:0], 75)):
            for _ in range(400):
                n = int(rng.integers(1, 300))
                s = np.unique(rng.integers(0, universe, n).astype(np.uint64))
                t = s[: len(s) - int(rng.integers(0, len(s) // 7 + 1))]
                t = np.unique(np.concatenate((t, rng.integers(0, universe, int(rng.integers(0, len(s) // 7 + 1))).astype(np.uint64))))
                if not len(t) or not ngramjoin.alike(s, t):
                    continue
                (a, k, used), (b, m, _) = ngramjoin.entries(s, costs, 75), ngramjoin.entries(t, costs, 75)
                assert len(np.intersect1d(a, b)) >= min(k, m)
                fired += used > 0
    assert fired > 100


def test_neighbourhoods_join_sets():
    """A set and one that lacks one shingle of every segment that the budget pays for meet by a neighbourhood alone."""
    costs = ngramjoin.Costs(np.zeros(0, np.uint64), np.zeros(0, np.int64), 75)
    rng = np.random.default_rng(8)
    met = 0
    for _ in range(300):
        s = np.unique(rng.integers(0, 1 << 62, 254).astype(np.uint64))
        band, most = ngramjoin.schemes(len(s), 75)[0]
        segment, _ = ngramjoin.segment_of(s, band, 75)
        _, first = np.unique(segment, return_index=True)
        t = np.delete(s, first[: len(s) // 4])
        if ngramjoin.alike(s, t):
            (a, _, used), (b, _, _) = ngramjoin.entries(s, costs), ngramjoin.entries(t, costs)
            assert len(np.intersect1d(a, b))
            met += used > 0
    assert met > 20


def test_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 90, int(rng.integers(1, 80))).astype(np.uint64)) for _ in range(60)]
    sets += [np.unique(rng.integers(100, 4000, 30).astype(np.uint64)) for _ in range(30)]
    assert (ngramjoin.intersections(sets, dense=8, cells=500) == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]).all()


def test_ngram_join_edges(spark):
    assert ngramjoin.join(documents(spark, [])).count() == 0
    got = ngramjoin.join(documents(spark, ["x y z", "x y z", None, BASE, BASE], [7, 7, 8, None, 2])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in got) == [(False, 2, 2), (False, 7, 7), (False, 7, 7), (False, 8, 8), (True, 0, 2)]


def test_ngram_join_null_ids(spark):
    """Near copies meet although the only ids of one of them are null."""
    near = " ".join([*BASE.split()[:295], "x", "y"])
    texts, ids = [BASE, near, words(80), words(80)], [5, None, None, None]
    got = ngramjoin.join(documents(spark, texts, ids)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles) for r in got) == sorted([(5, 5, len(shingle_set(BASE))), (0, 5, len(shingle_set(near))), *((0, 0, len(shingle_set(t))) for t in texts[2:])])


def test_components_of_long_chains(spark):
    """A chain of links is one component however long it is; rounds don't grow with its length."""
    rng = random.Random(11)
    names = rng.sample(range(10_000), 700)
    chain, other = names[:600], names[600:]
    links = [*itertools.pairwise(chain), *itertools.pairwise(other)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{n: min(chain) for n in chain}, **{n: min(other) for n in other}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ppm(spark):
    texts = [t for t in TEXTS if t is None or len(t) < 50_000]
    ids = [*range(len(texts) - 1), 3]
    got = ppm.score(documents(spark, texts, ids), head=20).collect()
    token = lambda t: (t or "").encode().translate(common.LOWER_BYTES).split()
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in ids]
    c, ends = collections.Counter(), 0
    for t, h in zip(texts, held, strict=True):
        if not h:
            c.update(token(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    base = lambda t: sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in token(t)) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
    want = sorted((i, h, len(token(t)) + 1, sum(c[w] > 0 for w in token(t)) + 1, n, round(base(t), 6)) for i, t, h in zip(ids, texts, held, strict=True))
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert ppm.score(documents(spark, [])).count() == 0


def test_adaptive_contexts():
    tokens = np.array([5, 6, 7, 8, 5, 6, 7, 8, 5, 6, 7, 9], np.uint64)
    tried, right = ppm.adaptive(tokens, tokens.astype(np.int64), np.zeros(12, np.int64))
    assert tried[0].tolist() == [False] * 7 + [True] * 5 and right[0].tolist() == [False] * 7 + [True] * 4 + [False]


def brute_quality(text):
    ws = (text or "").encode().split()
    windows = collections.Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    covered = {i + k for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(ws), sum(len(w.decode()) for w in ws), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    texts = [*TEXTS, "a b c a b c a b c x", "l 1\nl 1\n\n \nl 1 \nl 1", "#<>|*", "x y\n" * 40, "a b c d a b c"]
    measured = quality.measure(documents(spark, texts).withColumnRenamed("n_chars", "n_words"))
    got = {r.doc_id: r for r in quality.apply_rules(measured, []).collect()}
    for i, t in enumerate(texts):
        want = brute_quality(t)
        assert tuple(got[i][c] for c in quality.COUNTS[:5]) == want
        assert got[i].kept is not got[i].base_failed and got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert quality.measure(documents(spark, [])).count() == 0


def test_learned_rules(spark):
    texts = [words(80) + (" # # # #" if i % 3 == 0 else " x y z #") for i in range(240)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(240)] + [(1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rules = quality.fit(docs, labels)
    assert rules and rules[0][0][0] in ("n_symbols", "symbol_share")
    kept = {r.doc_id: r.kept for r in quality.apply_rules(quality.measure(docs), rules).collect()}
    assert all(kept[i] == (i % 3 != 0) for i in range(240))
    assert quality.fit(docs, labels.limit(0)) == []


def test_toxicity(spark):
    bad = ["vileword", "vilethings", "nastyone"]
    texts = [None, "", *(words(60) + (f" {random.choice(bad)} " + words(3) if i % 4 == 0 else "") for i in range(400))]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i + 2, 1, int(i % 4 == 0)) for i in range(300)] + [(2, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs.withColumnRenamed("n_chars", "score"), model).collect()}
    assert all((got[i + 2] >= 0.5) == (i % 4 == 0) for i in range(300, 400)) and got[0] < 0.5 and got[1] < 0.5
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}


def test_toxicity_without_spaces(spark):
    """What is far inside a run without spaces, or behind a mark outside ASCII, counts."""
    rng = random.Random(9)
    letters = [chr(0x4E00 + i) for i in range(200)]
    run = lambda n: "".join(rng.choice(letters) for _ in range(n))
    joined = lambda n: rng.choice("、。—…\u00a0\u200b").join(f"w{rng.randrange(400)}" for _ in range(n))
    bad = "\u9f00\u9f01\u9f02"
    texts = []
    for i in range(400):
        one = i % 4 == 0
        if i % 8 < 4:
            texts.append(run(rng.randint(10, 40)) + (bad if one else "") + run(rng.randint(5, 20)))
        else:
            texts.append(joined(20) + "—" + ("vileword" if one else "w7") + "。" + joined(5))
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(300, 400))


def test_toxicity_words():
    raw = lambda t: [bytes(d[0][a:b]).decode(errors="replace") for d, which, _ in [toxicity.words_in(pa.array([t]))] for a, b in zip(d[1][which], d[2][which], strict=True)]
    assert raw("It's Ünfair\u00a0or—not…") == ["it", "s", "Ünfair", "or", "not"]
    assert raw("abcdefghijklmnopqr") == [*("abcdefghijklmnopqr"[i : i + 15] for i in range(18))]
    assert raw("人、口") == ["人", "口"] and raw("人口山") == ["人口山", "口山", "山"] and raw("") == []
    long = [toxicity.words_in(pa.array([t])) for t in ("x" * 40 + "é" * 40, "é" * 9)]
    assert [len(which) for _, which, _ in long] == [80, 9]


def test_search(spark):
    """Clusters, a vector that many rows share, a row that is there twice, vectors that take no part."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 16))
    x = (centres[rng.integers(0, 5, 900)] + rng.normal(size=(900, 16))).astype(np.float32)
    x[100:400] = x[100]
    x, ids = np.vstack((x, x[100])).astype(float), [*range(900), 100]
    rows = [(i, r.tolist(), 1) for i, r in zip(ids, x, strict=True)] + [(1000, None, 1), (1100, [0.0] * 16, 1), (1200, [float("nan")] * 16, 1), (1300, [None] * 16, 1), (1400, [1.0] * 3, 1), (None, x[3].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<float>, rank int").repartition(3)
    found = collections.defaultdict(list)
    for r in crosspolytope.search(df, salt_rows=50).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.rank, r.score, r.vec_id))
    assert set(found) == set(range(0, 900, 100))
    hit = total = 0
    for own, q in enumerate(ids):
        if q % 100:
            continue
        d = np.sqrt(((x - x[own]) ** 2).sum(1))
        want = sorted((float(d[i]), ids[i]) for i in range(901) if i != own)[:10]
        got = [(s, v) for _, s, v in found[q]]
        if q == 100:  # both rows ask
            assert found[q][0::2] == found[q][1::2]
            got = got[::2]
        assert got == sorted(got) and all(abs(s - d[v]) < 1e-9 for s, v in got) and len(got) == 10
        hit, total = hit + len({v for _, v in got} & {v for _, v in want}), total + len({v for _, v in want})
        if 100 <= q < 400:
            assert [v for _, v in got] == [v for _, v in want]
    assert hit / total >= 0.9
    assert crosspolytope.search(df.limit(0)).count() == 0


def test_search_of_long_vectors(spark):
    """1,536 components; many queries share a vector."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 1536))
    x[10:120] = x[10]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, vector array<double>")
    found = collections.defaultdict(list)
    for r in crosspolytope.search(df, every=3).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    want = dict(brute_search(x, range(0, 300, 3)))
    assert all(found[q] == want[q] for q in range(12, 120, 3))
    assert all(len(v) == 10 for v in found.values()) and sum(len(set(found[q]) & set(w)) for q, w in want.items()) >= 0.9 * 10 * len(want)


def brute_search(x, queries, k=10):
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        yield q, np.argsort(d, kind="stable")[:k].tolist()


def test_search_with_second_polytope(spark):
    """Recall stays where buckets are refined: random vectors without clusters, bucket_rows so small that the second polytope is as large as it gets."""
    x = np.random.default_rng(8).normal(size=(6000, 32)).astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, vector array<double>")
    found = collections.defaultdict(set)
    for r in crosspolytope.search(df, every=60, bucket_rows=2).collect():
        found[r.query_id].add(r.vec_id)
    hits = [len(found[q] & set(want)) for q, want in brute_search(x, range(0, 6000, 60))]
    assert sum(hits) >= 0.9 * 10 * len(hits)


def test_search_in_small_tables(spark):
    """Every query has k rows where there are as many others, the nearest ones, however few the rows are."""
    x = np.random.default_rng(2).normal(size=(14, 64))
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(50 + i, [1.0, float(i), 2.0]) for i in range(4)] + [(99, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    found = collections.defaultdict(list)
    for r in crosspolytope.search(df, every=1, salt_rows=5).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    assert {q: found[q] for q in range(14)} == dict(brute_search(x, range(14)))
    assert all(sorted(found[50 + i]) == [50 + j for j in range(4) if j != i] for i in range(4)) and 99 not in found


def test_stored_tables_can_be_removed(spark):
    common.clear(spark)
    kept = common.stored(spark.range(5).toDF("x"))
    assert kept.count() == 5 and common.clear(spark) == 1 and common.clear(spark) == 0
    with pytest.raises(Exception, match="x|exist"):
        common.stored(kept)
    common.clear(spark)
