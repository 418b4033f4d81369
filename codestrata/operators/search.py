"""Symbol search: token scores, ranking, anchors, and the choice of a strategy."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import AMBIGUOUS, BAG_LEAD, CLEAR_LEAD, DEFINITION_KINDS, DISCOVERY_STOP_WORDS, FLOW_STOP_WORDS, FLOW_WORDS, FUZZY, IMPACT_WORDS, LOCATE_WORDS, MOST_ANCHORS


def tokenize(query: str) -> list[str]:
    """Words of a query that may name something, repeats kept."""
    return [w for w in re.sub(r"[^a-zA-Z0-9_/]", " ", query).split() if len(w) > 1 and w.lower() not in DISCOVERY_STOP_WORDS]


def tokens_of(text: Column) -> Column:
    """The same for a column of queries."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9_/]", " "), " +", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~F.lower(w).isin(*DISCOVERY_STOP_WORDS))


def is_peripheral(path: Column) -> Column:
    """Discovery's idea of tests, fixtures and the like."""
    p = F.lower(F.translate(path, "\\", "/"))
    base = F.regexp_extract(p, "([^/]*)$", 1)
    return p.rlike("(^|/)(tests?|__tests__|specs?|fixtures?|mocks?|examples?)(/)") | p.contains("scratch") | base.rlike(r"[.\-_](test|spec)[.\-_]") | base.rlike(r"^(test|spec)[.\-_]") | base.rlike(r"[.\-_](test|spec)\.[a-z0-9]+$")


def is_peripheral_anchor(path: Column) -> Column:
    """The anchor ranking's idea, which is another."""
    p = F.lower(F.translate(path, "\\", "/"))
    return p.rlike(r"(^|/)(tests?|scratch)(/|$)") | p.rlike(r"\.(test|spec)\.[a-z]+$") | p.startswith("scratch")


def discover(nodes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(id, score, rank, ...) of the nodes that a query's words fit best. nodes may have api_method, api_path and is_service."""
    tokens = tokenize(query)
    if not tokens:
        return nodes.limit(0).withColumns({"n_tokens": F.lit(0), "score": F.lit(0.0), "rank": F.lit(0)})
    name, qname, path = F.lower("name"), F.lower("qname"), F.lower(F.translate("path", "\\", "/"))
    has = set(nodes.columns)
    service = F.col("is_service") if "is_service" in has else F.lit(False)
    is_service = (F.col("kind") == "class") & (F.coalesce(service, F.lit(False)) | F.col("name").endswith("Service"))
    points, hits = F.lit(0.0), []
    if (m := re.search(r"(GET|POST|PUT|DELETE|PATCH)\s+(\S+)", query, re.I)) and "api_method" in has:
        points = points + F.when(F.concat_ws(" ", F.upper("api_method"), "api_path") == f"{m[1].upper()} {m[2]}", 15.0).otherwise(0.0)
    for word in tokens:
        t = word.lower()
        own = (
            F.when(is_service & (F.col("name") == word), 10.0).otherwise(0.0)
            + F.when(name == t, 8.0).when(name.contains(t), 4.0).otherwise(0.0)
            + F.when(qname == t, 6.0).when(qname.contains(t), 3.0).otherwise(0.0)
            + F.when(path.contains(t), F.when(F.col("kind").isin("class", "function"), 5.0).otherwise(2.0)).otherwise(0.0)
        )
        points = points + own
        hits.append(F.when(own > 0, F.lit(t)))
    distinct = F.size(F.array_compact(F.array_distinct(F.array(*hits)))) if hits else F.lit(0)
    scored = nodes.withColumns({"points": points, "n_tokens": distinct}).where("points > 0")
    # Words that hit in one file support each other.
    in_file = [F.max(F.when(h.isNotNull(), 1).otherwise(0)).over(Window.partitionBy("path")) for h in hits]
    unique = {t.lower(): i for i, t in enumerate(tokens)}
    together = sum((in_file[i] for i in unique.values()), F.lit(0))
    score = F.when(F.col("n_tokens") >= 2, F.col("points") * (1 + 0.5 * (F.col("n_tokens") - 1))).otherwise(F.col("points"))
    score = score + F.when(F.col("together") >= 2, 8.0 * (F.col("together") - 1)).otherwise(0.0)
    score = score * F.when(F.col("kind").isin(*DEFINITION_KINDS), 1.4).when(F.col("kind") == "variable", 0.5).otherwise(1.0)
    score = score + F.when((F.col("kind") != "file") & (F.length("name") <= 12), 2.0).otherwise(0.0)
    if not re.search(r"\b(tests?|specs?|fixtures?|mocks?)\b", query, re.I):
        score = score * F.when(is_peripheral(F.col("path")), 0.3).otherwise(1.0)
    ranked = scored.withColumn("together", together).withColumn("score", F.round(score, 6)).drop("points", "together")
    top = ranked.orderBy(F.desc("score"), "node_seq").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "node_seq")))


def rank_nodes(nodes: DataFrame, limit: int = AMBIGUOUS) -> DataFrame:
    """Ordinary files before tests, exported first, short qualified names first."""
    keys = [is_peripheral_anchor(F.col("path")), ~F.coalesce("exported", F.lit(False)), F.length("qname"), "node_seq"]
    return nodes.orderBy(*keys).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*keys)))


def resolve_anchor(nodes: DataFrame, query: str, mode: str = "auto", kind: str | None = None) -> tuple[str, DataFrame]:
    """
    'resolved', 'ambiguous' or 'not_found', and the candidates with rank (and score, after a search).

    In turn: the id itself, the qualified name, the name of a definition, and a search, whose best result stands
    if it is the only one, the only exact one, or leads the second clearly. mode: 'exact', 'search' or 'auto'. Equal scores rank by node_seq.
    """
    pool = nodes if kind is None else nodes.where(F.col("kind") == kind)
    wanted = query.lower()
    if mode != "search":
        tests = (F.col("id") == query, F.lower("qname") == wanted, (F.lower("name") == wanted) & F.col("kind").isin(*DEFINITION_KINDS))
        # One pass: every row has the first test that it meets, and only rows of the lowest stage stay.
        stage = F.when(tests[0], 1).when(tests[1], 2).when(tests[2], 3)
        met = pool.withColumn("stage", stage).where(F.col("stage").isNotNull())
        lowest = met.agg(F.min("stage").alias("s"), F.count_if(F.col("stage") == 1), F.count_if(F.col("stage") == 2)).first()
        if lowest[0] is not None:
            here = met.where(F.col("stage") == lowest[0]).drop("stage")
            found = rank_nodes(here)
            return ("resolved" if lowest[0] == 1 or here.limit(2).count() == 1 else "ambiguous"), found
        if mode == "exact":
            return "not_found", pool.limit(0).withColumn("rank", F.lit(1))
    found = discover(pool, query, FUZZY)
    top = found.select("id", "name", "qname", "score").orderBy("rank").collect()  # at most FUZZY rows
    if not top:
        return "not_found", found
    tail = wanted.rsplit(".", 1)[-1]
    exact = [r for r in top if r["name"].lower() == tail or r["qname"].lower() == wanted]
    pick = top[0] if len(top) == 1 else exact[0] if len(exact) == 1 else top[0] if top[0]["score"] >= CLEAR_LEAD * top[1]["score"] else None
    if pick:
        return "resolved", found.where(F.col("id") == pick["id"])
    return "ambiguous", found.where(F.col("rank") <= AMBIGUOUS)


def resolve_all(nodes: DataFrame, specs: list[dict], auto_pick=True, tolerate_missing=False) -> dict:
    """Anchors of several specs ({query, mode, kind}): status, ids in order, alternatives, missing queries."""
    ids, notes, missing, unclear = [], [], [], []
    for spec in specs:
        status, found = resolve_anchor(nodes, spec["query"], spec.get("mode", "auto"), spec.get("kind"))
        rows = found.orderBy("rank").collect()  # at most AMBIGUOUS or FUZZY rows
        if status == "not_found" or not rows:
            missing.append(spec["query"])
        elif status == "resolved":
            ids.append(rows[0]["id"])
        elif tolerate_missing and "score" in found.columns and len(rows) > 1 and rows[0]["score"] < BAG_LEAD * rows[1]["score"]:
            missing.append(spec["query"])
        elif auto_pick:
            ids.append(rows[0]["id"])
            notes.append((spec["query"], rows[0]["id"], [r["id"] for r in rows[1:4]]))
        else:
            unclear.append((spec["query"], [r["id"] for r in rows]))
    status = "not_found" if missing and not (tolerate_missing and ids) else "ambiguous" if unclear else "resolved"
    return {"status": status, "ids": ids, "notes": notes, "missing": missing, "unclear": unclear}


def strategy(text: Column) -> Column:
    """impact, flow or locate, by keywords; ties fall to locate."""
    low = F.lower(text)
    count = lambda words: sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    locate, flow, impact = count(LOCATE_WORDS), count(FLOW_WORDS), count(IMPACT_WORDS)
    return F.when((impact > locate) & (impact > flow), "impact").when(flow > locate, "flow").otherwise("locate")


def flow_terms(text: Column) -> Column:
    """The first words of a question that look like names: capitals, dots, underscores or slashes, or plain words that aren't stop words."""
    words = F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.regexp_replace(w, r"^[\"'(]+|[?!,;:()\"']+$", ""))
    named = lambda w: (F.length(w) > 1) & (w.rlike("[A-Z]") | w.rlike("[._/]") | (w.rlike("^[a-z]+$") & ~w.isin(*FLOW_STOP_WORDS)))
    return F.slice(F.filter(words, named), 1, MOST_ANCHORS)
