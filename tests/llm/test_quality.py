"""The learner of quality rules against a plain version of it, and the verdict of its list."""

import math
import random

import numpy as np
import pytest

pytest.importorskip("codestrata.llm")
from codestrata.llm import quality  # noqa: E402


def fits(row, rule):
    return all(row[k] > t if op == ">" else row[k] <= t for k, op, t in rule)


def plain_learn(x, bad, precision=0.9, most_rules=16, most_conditions=4):
    rules, left = [], list(range(len(x)))
    grows = lambda i: i % 3 != 2

    def best(inside):
        share = sum(bad[i] for i in inside) / len(inside)
        before, gain, found = math.log2(share) if share else 0, 1e-9, None
        for k in range(len(x[0])):
            by = sorted(inside, key=lambda i: x[i][k])
            cuts = [e for e in range(1, len(by)) if x[by[e]][k] > x[by[e - 1]][k]]
            if not cuts:
                continue
            cuts = [cuts[j] for j in sorted({int(v) for v in np.linspace(0, len(cuts) - 1, 64)})]
            for op in ("<=", ">"):
                for e in cuts:
                    own = by[:e] if op == "<=" else by[e:]
                    p = sum(bad[i] for i in own)
                    g = p * (math.log2(p / len(own)) - before) if p else -1
                    if g > gain * (1 + 1e-12):
                        gain, found = g, (k, op, (x[by[e - 1]][k] + x[by[e]][k]) / 2)
        return found

    def worth(rule):
        own = [i for i in left if not grows(i) and fits(x[i], rule)]
        return 2 * sum(bad[i] for i in own) / len(own) - 1 if own else -1.0

    while len(rules) < most_rules and sum(bad[i] for i in left if grows(i)) >= 5:
        rule, inside = [], [i for i in left if grows(i)]
        while len(rule) < most_conditions and not all(bad[i] for i in inside):
            condition = best(inside)
            if not condition:
                break
            rule.append(condition)
            inside = [i for i in inside if fits(x[i], [condition])]
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        covered = [i for i in left if fits(x[i], rule)] if rule else []
        held = [i for i in covered if not grows(i)]
        if not held or sum(bad[i] for i in held) < precision * len(held) or sum(bad[i] for i in covered) < precision * len(covered):
            break
        rules.append(rule)
        left = [i for i in left if i not in set(covered)]
    return rules


def test_learner():
    rng = random.Random(12)
    learned = 0
    for _ in range(12):
        n, width = rng.randint(40, 240), rng.randint(1, 5)
        x = [[rng.choice([rng.random(), rng.randrange(4) / 4]) for _ in range(width)] for _ in range(n)]
        bad = [row[0] > 0.7 or width > 1 and row[1] < 0.2 and row[0] > 0.3 or rng.random() < 0.03 for row in x]
        names = [f"s{k}" for k in range(width)]
        got = quality.learn(np.array(x), np.array(bad), names)
        want = plain_learn(x, bad)
        assert [[(names.index(k), op, pytest.approx(t)) for k, op, t in rule] for rule in got] == want
        learned += len(got)
    assert learned >= 8


def test_length_is_no_reason(spark):
    """Where long documents are as good as short ones, the list rejects by shares and keeps long good ones."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(300):
        n, good = rng.choice([60, 200, 2000]), i % 3 > 0
        text = [word() for _ in range(n)]
        for k in range(0, n, 40 if good else 4):
            text[k] += "#"
        rows.append((i, " ".join(text)))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rules = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert rules and all(name in quality.SHARES for rule in rules for name, _, _ in rule)
    measured = quality.measure(docs).withColumns(quality.shares())
    kept = {r.doc_id: r.kept for r in quality.apply_rules(quality.measure(docs), rules).collect()}
    assert kept == {i: bool(q) for i, q in labels}
    for r in measured.collect():
        assert kept[r.doc_id] == (not any(all(r[c] > t if op == ">" else r[c] <= t for c, op, t in rule) for rule in rules))
