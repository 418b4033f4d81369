"""Token budgets and span merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ROLE_PRIORITY, SNIPPET, SPAN_GAP, TOKEN_BUDGET

#: Kinds that are never shown with their source.
PLAIN_KINDS = ("class", "file", "module", "project", "package")
#: Rows are summed in blocks of so many numbers.
BLOCK = 4096


def tokens_for(chars: Column) -> Column:
    return F.ceil(chars / 4)


def role_priority(role: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ROLE_PRIORITY.items() for x in kv])[role], F.lit(0))


def allocate(rows: DataFrame, budget: int = TOKEN_BUDGET, by: tuple[str, ...] = ()) -> DataFrame:
    """
    (by..., seq, id, level) for rows(by..., seq, id, kind, role, base, source_chars): FULL, SNIPPET, SIGNATURE or OMIT.

    base: characters of a row's signature form. Each group starts with all rows as signatures, at a cost of all
    bases and of a list of ids and roles. If that is over the budget, rows go by rising priority until it fits;
    else they are raised by falling priority, to their source if it fits, else to a snippet if that fits. A row
    that doesn't fit is passed over and later ones may still fit, so this is a fold over the group's sorted rows,
    not a running sum. Rows are folded only where a group's signatures fit: since each costs 19 characters at least, they
    are at most 4 * budget / 19. In other groups, of any size, rows go as long as the bases of those before them leave
    it over the budget: that is a running sum, by blocks of `seq` and then within each, so that no task holds a group.
    """
    most = 4 * budget
    rows = rows if by else rows.withColumn("_one", F.lit(1))
    keys = by or ("_one",)
    row = F.struct("priority", "seq", "id", "kind", F.col("base").cast("long").alias("base"), F.coalesce("source_chars", F.lit(0)).cast("long").alias("chars"))
    rows = rows.withColumns({"priority": role_priority(F.col("role")), "_block": F.floor(F.col("seq") / BLOCK), "_listed": 19 + F.length("id") + F.length("role")})
    blocks = rows.groupBy(*keys, "priority", "_block").agg(F.sum("base").alias("_base"), F.sum("_listed").alias("_list"), F.count("*").alias("_n"), F.max(F.col("base").isNull()).alias("_gap"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("priority", F.asc_nulls_last("_block")).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.sum(c).over(group)
    used = total("_base") + total("_list") + 2 + F.greatest(total("_n") - 1, F.lit(0))
    ends = [*keys, "priority", "_block"]
    blocks = blocks.select(*(F.col(k).alias(f"_at_{k}") for k in ends), used.cast("long").alias("used"), F.sum("_base").over(earlier).alias("_gone"), F.max("_gap").over(earlier).alias("_unknown"))
    placed = rows.join(blocks, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in ends)))
    inside = Window.partitionBy(*ends).orderBy(F.asc_nulls_last("seq")).rowsBetween(Window.unboundedPreceding, -1)
    zero, no = F.lit(0), F.lit(False)
    gone = F.coalesce("_gone", zero) + F.coalesce(F.sum("base").over(inside), zero)
    unknown = F.coalesce("_unknown", no) | F.coalesce(F.max(F.col("base").isNull()).over(inside), no)  # once a base of unknown length has gone, nothing is known to be over
    dropped = placed.where(F.col("used") > most).withColumn("level", F.when(~unknown & (F.col("used") - gone > most), "OMIT").otherwise("SIGNATURE"))
    dropped = dropped.select(*by, F.col("seq").cast("long").alias("seq"), "id", "level")
    grouped = placed.where(~F.coalesce(F.col("used") > most, no)).groupBy(*keys).agg(F.collect_list(row).alias("rows"), F.first("used").alias("used"))
    out_type = "array<struct<seq:bigint,id:string,level:string>>"

    def step(level, cost):
        return lambda acc, x: F.struct(
            (acc["used"] + cost(acc, x)).alias("used"),
            F.concat(acc["out"], F.array(F.struct(x["seq"].cast("long").alias("seq"), x["id"].alias("id"), level(acc, x).alias("level")))).alias("out"),
        )

    start = F.struct(F.col("used").alias("used"), F.array().cast(out_type).alias("out"))
    falling = F.array_sort("rows", lambda a, b: F.when(a["priority"] != b["priority"], b["priority"] - a["priority"]).otherwise(F.signum(a["seq"] - b["seq"]).cast("int")).cast("int"))
    plain = lambda x: x["kind"].isin(*PLAIN_KINDS) | (x["chars"] == 0)
    full = lambda acc, x: ~plain(x) & (acc["used"] + x["chars"] <= most)
    snippet = lambda acc, x: ~plain(x) & (acc["used"] + F.least(F.lit(SNIPPET), x["chars"]) <= most)
    raised = F.aggregate(
        falling,
        start,
        step(
            lambda acc, x: F.when(full(acc, x), "FULL").when(snippet(acc, x), "SNIPPET").otherwise("SIGNATURE"),
            lambda acc, x: F.when(full(acc, x), x["chars"]).when(snippet(acc, x), F.least(F.lit(SNIPPET), x["chars"]).cast("long")).otherwise(F.lit(0)),
        ),
    )
    return grouped.select(*by, F.explode(raised["out"]).alias("x")).select(*by, "x.*").unionByName(dropped)


def merge_spans(spans: DataFrame, by: tuple[str, ...], start: str = "start_line", end: str = "end_line", gap: int = SPAN_GAP) -> DataFrame:
    """(by..., span, start, end, n): spans that overlap or lie at most `gap` apart become one."""
    order = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0))
    marked = marked.withColumn("span", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "span").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))


def spans_of(rows: DataFrame, merged: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Each row of FULL or SNIPPET with the merged span that holds it."""
    m = merged.select(*by, "span", F.col("start_line").alias("span_start"), F.col("end_line").alias("span_end"))
    return rows.where(F.col("level").isin("FULL", "SNIPPET")).join(m, list(by)).where((F.col("start_line") >= F.col("span_start")) & (F.col("end_line") <= F.col("span_end")))
