"""Union of partial models and replacement of a file's rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAST_LINE = 100_000


def merge_partials(files: DataFrame, parts: dict[str, DataFrame], project_id: str, project_name: str) -> dict[str, DataFrame]:
    """
    One model of all files' facts: a project symbol, a symbol for each file (made up where a file brought none, kept once where it brought
    several), and an `owns` edge from the project to each file. files(file_seq, path); parts: tables of facts by name.
    """
    symbols, spark = parts["symbols"], files.sparkSession
    first = symbols.where(F.col("kind") == "file").groupBy("id").agg(F.min("sym_seq").alias("sym_seq"))
    others = symbols.where(F.col("kind") != "file").unionByName(symbols.join(first, ["id", "sym_seq"], "left_semi"))
    missing = files.join(first.select("id"), F.concat(F.col("path"), F.lit("::"), F.col("path")) == F.col("id"), "left_anti")
    made = missing.select((F.col("file_seq") * 10**7).alias("sym_seq"), F.concat(F.col("path"), F.lit("::"), F.col("path")).alias("id"), F.lit("file").alias("kind"), F.col("path").alias("name"), F.col("path").alias("qname"), "path", F.lit(0).alias("sl"), F.lit(0).alias("sc"), F.lit(LAST_LINE).alias("el"), F.lit(0).alias("ec"), F.lit(True).alias("exported"), F.lit("public").alias("visibility"))
    project = spark.createDataFrame([(-1, project_id, "project", project_name, project_name, "", 0, 0, 0, 0, True, "public")], "sym_seq long, id string, kind string, name string, qname string, path string, sl int, sc int, el int, ec int, exported boolean, visibility string")
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [project, others, made])
    owned = files.select((F.col("file_seq") - 10**12).alias("cont_seq"), F.lit(project_id).alias("parent_id"), F.concat(F.col("path"), F.lit("::"), F.col("path")).alias("child_id"), F.lit("owns").alias("kind"))
    return parts | {"symbols": every, "containments": owned.unionByName(parts["containments"])}


def replace_file(current: DataFrame, path: str, new: DataFrame | None, key: str = "id") -> DataFrame:
    """Rows of one file replaced (or, without new ones, removed); rows whose key is there already are skipped."""
    kept = current.where(F.col("path") != path)
    return kept if new is None else kept.unionByName(new.join(kept.select(key), key, "left_anti"), allowMissingColumns=True)


def replace_containments(current: DataFrame, path: str, new: DataFrame | None) -> DataFrame:
    """Containments with an end in the file go; new ones come."""
    inside = lambda c: F.split_part(F.col(c), F.lit("::"), F.lit(1)) == path
    kept = current.where(~inside("parent_id") & ~inside("child_id"))
    return kept if new is None else kept.unionByName(new)


def replace_edges(edges: DataFrame, path: str, new: DataFrame | None, sep: str = "::") -> DataFrame:
    """Edges with an end in the file go; new ones that touch it come."""
    inside = (F.split_part(F.col("src"), F.lit(sep), F.lit(1)) == path) | (F.split_part(F.col("dst"), F.lit(sep), F.lit(1)) == path)
    kept = edges.where(~inside)
    return kept if new is None else kept.unionByName(new.where(inside))
