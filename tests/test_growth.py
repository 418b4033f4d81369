"""What steps hand on: no more rows or bytes than their input calls for."""

import os

import pytest

from codestrata import queries as own
from codestrata.operators import budget, resolve, traverse
from codestrata.plans import engine
from codestrata.plans import plan as plans
from codestrata.projects import source_files

DATA = "/root/testdata/sf0.001"


def steps(plan):
    """All operators of a plan that has run, those of its stages too."""
    yield plan
    name = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    for p in below:
        yield from steps(p)


def figures(df, kind: str, metric: str) -> list[int]:
    """A metric of each operator whose name holds `kind`."""
    return [p.metrics().apply(metric).value() for p in steps(df._jdf.queryExecution().executedPlan()) if kind in p.nodeName()]


@pytest.fixture
def tables(spark, tmp_path):
    def put(**frames):
        for name, df in frames.items():
            df.write.parquet(os.path.join(tmp_path, f"{name}.parquet"))
        return str(tmp_path)

    return put


def test_resolution_meets_one_offer(spark, tables):
    """Suppliers that share a name don't multiply the references to it."""
    d = tables(
        orders=spark.range(1300).selectExpr("id as o_orderkey", "id % 10 as o_custkey"),
        customer=spark.range(10).selectExpr("id as c_custkey", "int(id % 5) as c_nationkey"),
        supplier=spark.range(12800).selectExpr("id as s_suppkey", "int(id % 3) as s_nationkey"),
    )
    found = own.name_resolution(spark, d)
    rows = {r.ref_seq: (r.target, r.method) for r in found.collect()}
    near = lambda k: min((s for s in range(k % 130, 12800, 128) if s % 3 == k % 10 % 5), default=None) if k % 130 < 128 else None
    want = {k: (near(k), "scope") if near(k) is not None else (k % 130, "global_fallback") if k % 130 < 128 else (None, "unresolved") for k in range(1300)}
    assert rows == want
    assert max(figures(found, "Join", "numOutputRows")) <= 1300


def test_large_groups_are_not_folded(spark):
    """In a group over the budget rows go by a running sum over all of its blocks; only what fits is folded."""
    rows = spark.range(20_000).selectExpr("'big' as g", "id as seq", "concat('d:', id) as id", "'function' as kind", "if(id % 3 = 0, 'anchor', 'path') as role", "40 + id % 100 as base", "id as source_chars")
    rows = rows.unionAll(spark.createDataFrame([("small", 1, "a", "function", "path", 10, 10**7), ("small", 2, "b", "function", "anchor", 10, 5), ("none", 1, "c", "class", "path", 10, 5)], rows.schema))
    found = budget.allocate(rows, 200_000, ("g",))
    levels = {(r.g, r.id): r.level for r in found.collect()}
    big = [(k, "anchor" if k % 3 == 0 else "path", 40 + k % 100) for k in range(20_000)]
    used = sum(b + 19 + len(f"d:{k}") + len(role) for k, role, b in big) + 2 + len(big) - 1
    want = {("small", "a"): "SNIPPET", ("small", "b"): "FULL", ("none", "c"): "SIGNATURE"}
    for k, _, b in sorted(big, key=lambda x: (x[1] == "anchor", x[0])):
        want["big", f"d:{k}"] = "OMIT" if used > 800_000 else "SIGNATURE"
        used -= b if used > 800_000 else 0
    assert levels == want and 1000 < sum(v == "SIGNATURE" for v in want.values()) < 10_000
    assert max(figures(found, "Generate", "numOutputRows")) == 3


def watch(monkeypatch, seen) -> None:
    """From now on seen() gets every frame that is cut off."""
    for m in (engine, resolve, traverse):
        monkeypatch.setattr(m, "cut", lambda df, real=m.cut: (seen(df), real(df))[1])


def test_build_and_slices_send_no_tables(spark, monkeypatch):
    """Neither building a project nor reading its members' sources broadcasts a table of it."""
    before, joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), []
    watch(monkeypatch, lambda df: joins.append(df._jdf.queryExecution().executedPlan().toString()))
    monkeypatch.setattr(own, "_built", {})
    slices = own.project_slices(spark, DATA)
    assert sum("Join" in x for x in joins) > 10 and not [x for x in joins if "Broadcast" in x]
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    assert slices.collect() and not figures(slices, "BroadcastExchange", "dataSize")


def test_answer_sends_its_own_rows(spark, monkeypatch):
    """What an answer broadcasts is bounded by its node limit, not by the project."""
    g = engine.build(spark, "shop", source_files(spark, DATA))
    assert g.nodes.count() > 200
    sent = []

    def run(df):
        df.collect()
        sent.extend(figures(df, "BroadcastExchange", "numOutputRows"))

    watch(monkeypatch, run)
    assert engine.Engine(g).answer(plans.explore_region(["pkg/nation_3.py::run_3"], "outgoing", 2))["status"] == "ok"
    assert sent and max(sent) <= 30
