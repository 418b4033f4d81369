"""Lookups over the model's tables, as keyed DataFrames for joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def position(line: str, column: str) -> Column:
    return F.struct(F.col(line).alias("l"), F.col(column).alias("c"))


def contains(outer: str, inner: str) -> Column:
    """Whether one range holds another, ends included. outer, inner: prefixes of sl, sc, el and ec."""
    return (position(f"{outer}sl", f"{outer}sc") <= position(f"{inner}sl", f"{inner}sc")) & (position(f"{inner}el", f"{inner}ec") <= position(f"{outer}el", f"{outer}ec"))


def by_id(symbols: DataFrame) -> DataFrame:
    """The last symbol of each id."""
    return symbols.groupBy("id").agg(F.max_by(F.struct(*symbols.columns), "sym_seq").alias("s")).select("s.*")


def modules(files: DataFrame) -> DataFrame:
    """(module, path): what a file can be imported as: its path without extension, that with dots, and its folder if it stands for one; the last file wins."""
    base = F.regexp_replace("path", r"\.[^./]*$", "")
    folder = F.regexp_replace(base, r"/?[^/]*$", "")
    stands = F.regexp_extract(base, r"([^/]*)$", 1).isin("__init__", "index")
    keys = F.array_distinct(F.array_compact(F.array(base, F.replace(base, F.lit("/"), F.lit(".")), F.when(stands & (folder != ""), folder), F.when(stands & (folder != ""), F.replace(folder, F.lit("/"), F.lit("."))))))
    return files.select(F.explode(keys).alias("module"), "path", "file_seq").groupBy("module").agg(F.max_by("path", "file_seq").alias("path"))


def bindings(local_bindings: DataFrame) -> DataFrame:
    """The last binding of each name in each owner."""
    return local_bindings.groupBy("owner_symbol_id", "name").agg(F.max_by("type_chain", "bind_seq").alias("type_chain"))


def innermost(items: DataFrame, scopes: DataFrame, exclude_own: bool, key: str = "id") -> DataFrame:
    """
    (key, scope_id): the smallest scope of the same file that holds each item's range; of equal ones the first. exclude_own: scopes that the
    item itself opens don't count. An equi-join on the file with the range as a further condition, so a file's items meet its own scopes only.
    """
    s = scopes.select("path", "scope_seq", F.col("id").alias("scope_id"), "owner_symbol_id", *(F.col(c).alias(f"s_{c}") for c in ("sl", "sc", "el", "ec")))
    size = (F.col("s_el") - F.col("s_sl")) * 10_000 + (F.col("s_ec") - F.col("s_sc"))
    met = items.select(key, "path", "sl", "sc", "el", "ec").join(s, "path").where(contains("s_", ""))
    if exclude_own:
        met = met.where(~F.col("owner_symbol_id").eqNullSafe(F.col(key)))
    return met.groupBy(key).agg(F.min_by("scope_id", F.struct(size, F.col("scope_seq"))).alias("scope_id"))


def scope_ancestors(scopes: DataFrame) -> DataFrame:
    """(scope_id, anc_id, depth): each scope's parents up to the last, or to one that it has passed; itself at depth 0."""
    from ..lineage import cut

    parent = scopes.select(F.col("id").alias("anc_id"), "parent_scope_id")
    level = cut(scopes.select(F.col("id").alias("scope_id"), F.col("id").alias("anc_id"), F.array("id").alias("passed")).distinct())
    found, d = level.select("scope_id", "anc_id", F.lit(0).alias("depth")), 0
    while True:
        d += 1
        up = level.join(parent, "anc_id").where(F.col("parent_scope_id").isNotNull() & ~F.array_contains("passed", F.col("parent_scope_id")))
        level = cut(up.select("scope_id", F.col("parent_scope_id").alias("anc_id"), F.concat("passed", F.array("parent_scope_id")).alias("passed")))
        if level.isEmpty():
            break
        found = found.unionAll(level.select("scope_id", "anc_id", F.lit(d).alias("depth")))
        if d % 16 == 0:
            found = cut(found)
    return found


def retrieval(nodes: DataFrame) -> DataFrame:
    """nodes with the keys that searches use: lower-cased names, 'METHOD path', service name."""
    service = (F.col("kind") == "class") & (F.coalesce("is_service", F.lit(False)) | F.col("name").endswith("Service"))
    return nodes.withColumns({"name_lc": F.lower("name"), "qname_lc": F.lower("qname"), "endpoint_key": F.when(F.col("api_method").isNotNull(), F.concat_ws(" ", "api_method", "api_path")), "service_name": F.when(service, F.col("name"))})


def last_by(nodes: DataFrame, key: str) -> DataFrame:
    """The last node of each key."""
    return nodes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by("id", "node_seq").alias("id"))


def with_first(rows: DataFrame, by: tuple[str, ...], *order) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
