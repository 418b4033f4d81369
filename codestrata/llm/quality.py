"""Op 9, quality rules: learned decision lists.

One pass gives each document's statistics. A bounded sample of labelled documents (at most `most_labelled`,
by the hash of their id; every document's statistics are made from its whole text) trains a list of rules by
sequential covering: a rule grows on two thirds of the sample by adding the threshold condition with the
largest FOIL gain (conditions look at shares, not at counts, which grow with the document), is pruned on the last third (conditions go from the end as long as (p - n) / (p + n) does
not fall), and stays if its precision on that third reaches `precision`. What it covers is taken out, and the
next rule follows. The list becomes one Spark conditional expression, in order: the first rule that holds
rejects, what none rejects is kept. Two fixed rules stand before it (base_failed).

Null and empty texts have no words and fail. Empty tables give no rows; without labels no rule is learned and
only the fixed rules reject. Documents with conflicting labels don't train. Repeated rows: each row has its
own result. Other columns of the input are kept by `apply_rules`, except those named like a statistic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, pieces, stored, table, text_bytes, word_hashes, word_spans

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct", "n_top")
SHARES = ("mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share", "top_share")
#: Fixed: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"


def _class(*parts: bytes) -> np.ndarray:
    mask = np.zeros(256, np.int64)
    mask[list(b"".join(parts))] = 1
    return mask


WORD_CHAR = np.where(IS_SPACE, 0, 1) * (np.arange(256) & 0xC0 != 0x80)
CLASSES = np.stack([WORD_CHAR, _class(SYMBOLS), _class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class(b"0123456789"), _class(b"!?")], axis=1)


def statistics(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    data, at = text_bytes(batch.column("text"))
    starts, ends, text = word_spans(data, at)
    n = len(at) - 1
    out = {c: np.zeros(n, np.int64) for c in COUNTS}
    out["n_words"] = np.bincount(text, minlength=n)
    words = word_hashes(data, starts, ends).view(np.int64)
    first = np.searchsorted(text, np.arange(n + 1))
    line_feeds = np.flatnonzero(data == 10)
    for i in range(n):
        a, b = at[i], at[i + 1]
        if a == b:
            continue
        own = data[a:b]
        out["word_chars"][i], out["n_symbols"][i], out["n_upper"][i], out["n_digits"][i], out["n_marks"][i] = np.bincount(own, minlength=256) @ CLASSES
        w = words[first[i] : first[i + 1]]
        if not len(w):
            continue
        counts = np.unique(w, return_counts=True)[1]
        out["n_distinct"][i], out["n_top"][i] = len(counts), counts.max()
        out["n_repeat_words"][i] = repeated_words(w)
        feeds = line_feeds[np.searchsorted(line_feeds, a) : np.searchsorted(line_feeds, b)]
        cuts = np.concatenate(([a], feeds + 1, [b]))
        # a line counts if a word starts in it
        s = starts[first[i] : first[i + 1]]
        full = np.searchsorted(s, cuts[1:]) > np.searchsorted(s, cuts[:-1])
        out["n_lines"][i] = full.sum()
        if full.sum() > 1:
            raw = own.tobytes()
            seen: set[bytes] = set()
            for x, y in zip((cuts[:-1][full] - a).tolist(), (cuts[1:][full] - a).tolist(), strict=True):
                line = raw[x : y - 1] if y - 1 < len(raw) and raw[y - 1] == 10 else raw[x:y]
                out["n_dup_lines"][i] += line in seen
                seen.add(line)
    return out


def repeated_words(words: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(words) < 4:
        return 0
    u = words.view(np.uint64)
    windows = (u[:-2] * np.uint64(0x9E3779B97F4A7C15) + u[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + u[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(again) + k] |= again
    return int(covered.sum())


def measure(docs: DataFrame) -> DataFrame:
    """docs with the columns COUNTS."""
    held = [f for f in docs.schema.fields if f.name not in COUNTS]
    names = [f.name for f in held]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in held), *(f"{c} long" for c in COUNTS)])

    def run(batches):
        for batch in pieces(batches):
            found = statistics(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(found[c], pa.int64()) for c in COUNTS)], [*names, *COUNTS])

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def shares() -> dict[str, Column]:
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return {
        "mean_word_chars": per("word_chars", "n_words"), "symbol_share": per("n_symbols", "word_chars"), "dup_line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words"),
        "upper_share": per("n_upper", "word_chars"), "digit_share": per("n_digits", "word_chars"), "mark_share": per("n_marks", "n_words"), "distinct_share": per("n_distinct", "n_words"), "top_share": per("n_top", "n_words"),
    }


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = 0.9, most_rules: int = 16, most_conditions: int = 4) -> list[list[tuple[str, str, float]]]:
    """Rules that reject, in order; each a conjunction of (statistic, '<=' or '>', threshold). x: a row for each document."""
    if not len(x):
        return []
    grow = np.arange(len(x)) % 3 != 2
    rules = []
    left = np.ones(len(x), bool)
    while len(rules) < most_rules and (left & grow & bad).sum() >= 5:
        rule, inside = [], left & grow
        while len(rule) < most_conditions and (inside & ~bad).any():
            if not (best := best_condition(x, bad, inside)):
                break
            rule.append(best)
            inside = inside & holds(x, best)
        while rule and len(rule) > 1 and worth(x, bad, left & ~grow, rule[:-1]) >= worth(x, bad, left & ~grow, rule):
            rule.pop()
        covered = left.copy()
        for c in rule:
            covered &= holds(x, c)
        held_out = covered & ~grow
        if not rule or not held_out.any() or bad[held_out].mean() < precision or bad[covered].mean() < precision:
            break
        rules.append([(names[k], op, t) for k, op, t in rule])
        left &= ~covered
    return rules


def holds(x: np.ndarray, condition) -> np.ndarray:
    k, op, t = condition
    return x[:, k] > t if op == ">" else x[:, k] <= t


def worth(x, bad, among, rule) -> float:
    for c in rule:
        among = among & holds(x, c)
    return (2 * bad[among].mean() - 1) if among.any() else -1.0


def best_condition(x, bad, inside):
    """The condition with the largest FOIL gain among the rows `inside`, at up to 64 thresholds a statistic."""
    rows, y = x[inside], bad[inside]
    before = np.log2(y.mean()) if y.any() else 0
    best, gain = None, 1e-9
    for k in range(x.shape[1]):
        order = np.argsort(rows[:, k], kind="stable")
        v, cum = rows[order, k], np.concatenate(([0], np.cumsum(y[order])))
        ends = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(ends):
            continue
        ends = ends[np.unique(np.linspace(0, len(ends) - 1, 64).astype(int))]
        for op, p, n in (("<=", cum[ends], ends), (">", cum[-1] - cum[ends], len(v) - ends)):
            with np.errstate(divide="ignore", invalid="ignore"):
                g = np.where(p > 0, p * (np.log2(p / n) - before), -1)
            if g.max() > gain:
                gain, at = g.max(), ends[g.argmax()]
                best = (k, op, float((v[at - 1] + v[at]) / 2))
    return best


def as_expression(rules) -> Column:
    """The list as an ordered conditional: false where the first matching rule rejects, else true."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for name, op, t in rule:
            test = test & (F.col(name) > t if op == ">" else F.col(name) <= t)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000, precision: float = 0.9):
    """Rules learned from a bounded sample of labelled documents (labels.quality 0: bad). docs: measured, or with the texts."""
    clear = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2")
    sample = clear.select("doc_id", "q").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    rows = docs.join(F.broadcast(sample), "doc_id")  # at most most_labelled ids
    if "n_words" not in docs.columns:
        rows = measure(rows.select("doc_id", "q", "text"))
    names = [*SHARES]  # no counts: a long document isn't worse than a short one
    rows = rows.where(~base_failed()).withColumns(shares()).groupBy("doc_id").agg(F.min(F.struct(*names)).alias("x"), F.min("q").alias("q"))
    found = rows.select("doc_id", "q", "x.*").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled).toPandas()
    return learn(found[names].to_numpy(float), found["q"].to_numpy() == 0, names, precision)


def apply_rules(measured: DataFrame, rules) -> DataFrame:
    """measured with base_failed and kept."""
    out = measured.withColumns(shares()).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & as_expression(rules)).drop(*SHARES)


def query(spark, sf_dir: str) -> DataFrame:
    measured = stored(measure(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    rules = fit(measured, table(spark, sf_dir, "labels"))
    return apply_rules(measured, rules).select("doc_id", *COUNTS[:5], "base_failed", "kept")
