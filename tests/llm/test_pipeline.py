"""The pipeline's stages against plain versions, on the smallest tables."""

import collections
import itertools
import random

import pyarrow as pa
import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from codestrata.llm import mixing, quality, toxicity  # noqa: E402
from codestrata.llm.common import LOWER_BYTES, stored, table  # noqa: E402

DATA = "/root/testdata/sf0.001"


def shingle_set(text):
    w = (text or "").encode().translate(LOWER_BYTES).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    docs = table(spark, DATA, "documents")
    labels = table(spark, DATA, "labels")
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality rules", "n-gram join", "source mix", "piece encoding"]

    one = stored(stages["toxicity"](spark, docs, DATA))
    assert one.columns == pipeline.COLUMNS
    model = toxicity.fit(docs, labels)
    scores = dict(zip(rows, model.score(pa.array([r.text for r in rows.values()], pa.string())), strict=True))
    kept = {i for i, s in scores.items() if s < 0.5}
    assert {r.doc_id for r in one.collect()} == kept and len(kept) < len(rows)

    two = stored(stages["quality rules"](spark, one, DATA))
    rules = quality.fit(one, labels)
    measured = {r.doc_id: r for r in quality.measure(one).withColumns(quality.shares()).collect()}
    bad = lambda r: r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words or any(all(r[c] > t if op == ">" else r[c] <= t for c, op, t in rule) for rule in rules)
    kept = {i for i in kept if not bad(measured[i])}
    assert two.columns == pipeline.COLUMNS and {r.doc_id for r in two.collect()} == kept

    three = stored(stages["n-gram join"](spark, two, DATA))
    sets = {i: shingle_set(rows[i].text) for i in sorted(kept)}
    label = {i: i for i in sets}
    for i, j in itertools.combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
            a, b = sorted((label[i], label[j]))
            label = {k: a if v == b else v for k, v in label.items()}
    kept = {i for i, v in label.items() if i == v}
    assert three.columns == pipeline.COLUMNS and sorted(r.doc_id for r in three.collect()) == sorted(kept)

    four = stored(stages["source mix"](spark, three, DATA))
    got = collections.Counter(r.doc_id for r in four.collect())
    assert four.columns == pipeline.COLUMNS and set(got) == kept
    counts = collections.Counter(rows[i].source for i in kept)
    parts = mixing.whole_parts({s: n**0.7 for s, n in counts.items()}, 4096)
    blocks, dealt, through = {s: -(-n // 16) for s, n in counts.items()}, collections.Counter(), set()
    for source, _ in itertools.cycle(mixing.schedule(parts)):
        dealt[source] += 1
        if dealt[source] == blocks[source]:
            through.add(source)
        if through == set(counts):
            break
    for s, n in counts.items():  # every round through a source gives each of its rows once
        times = [got[i] for i in kept if rows[i].source == s]
        assert min(times) >= dealt[s] // blocks[s] and max(times) <= -(-dealt[s] // blocks[s])
        assert sum(times) >= dealt[s] // blocks[s] * n

    five = stages["piece encoding"](spark, four, DATA).collect()
    lib = sentencepiece.SentencePieceProcessor(model_file=pipeline.public_tokenizers.path("piece_bpe_32k.model"))
    assert collections.Counter(r.doc_id for r in five) == got
    for r in five[::5]:
        assert r.ids == lib.encode(rows[r.doc_id].text) and r.round_trip and r.n_tokens == len(r.ids)


def test_unlike_with_null_and_repeated_ids(spark):
    """Each group of near copies keeps one row, and nothing else is lost, whatever the ids."""
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(100))
    a, b, c, d, e, f = (text() for _ in range(6))
    near = lambda t: t + " more words"
    rows = [(None, a), (None, b), (None, near(b)), (7, c), (7, d), (1, near(d)), (7, c), (None, near(c)), (2, e), (2, f), (3, ""), (3, None), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = collections.Counter((r.doc_id, r.text) for r in pipeline.unlike(spark, docs, DATA).collect())
    of_b = {(None, b), (None, near(b))} & set(got)
    assert len(of_b) == 1
    assert got == collections.Counter([(None, a), *of_b, (7, c), (1, near(d)), (2, e), (2, f), (3, ""), (3, None), (None, None), (None, "")])
