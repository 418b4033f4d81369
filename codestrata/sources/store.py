"""Saving and loading a model: a Parquet table for each kind of row, or one JSON document."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EXTERNALS, RESOLVED, TABLES

FOLDER, DOCUMENT = ".codestrata", "semantic-model.json"


def save(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def export_json(tables: dict[str, DataFrame], meta: dict, root: str) -> str:
    """One JSON document for viewers: a small model's rows pass through the driver, row by row."""
    os.makedirs(os.path.join(root, FOLDER), exist_ok=True)
    path = os.path.join(root, FOLDER, DOCUMENT)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(meta, indent=2)[:-2])
        for name, df in tables.items():
            f.write(f',\n  "{name}": [')
            for i, row in enumerate(df.toJSON().toLocalIterator()):
                f.write(("," if i else "") + "\n    " + row)
            f.write("\n  ]")
        f.write("\n}\n")
    return path


def find_document(at: str) -> str:
    """The model's document: a .json file itself, or beside, below or above a folder; the first there is."""
    tries = [at] if at.endswith(".json") else [os.path.join(at, *p) for p in ((DOCUMENT,), (FOLDER, DOCUMENT), ("..", FOLDER, DOCUMENT))]
    for path in tries:
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                json.load(f)
            return path
    raise FileNotFoundError(f"no model at {at}")


def fields(schema: str) -> str:
    return f"array<struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in schema.split(','))}>>"


def load_json(spark: SparkSession, at: str) -> dict[str, DataFrame]:
    """The tables of a model's document; those that it lacks are empty."""
    known = TABLES | {"resolved_refs": RESOLVED, "unresolved_refs": TABLES["refs"], "externals": EXTERNALS}
    document = spark.read.schema(", ".join(f"{t} {fields(x)}" for t, x in known.items())).option("multiLine", True).json(find_document(at))
    return {t: document.select(F.explode(t).alias("x")).select("x.*") for t in known}


def report(tables: dict[str, DataFrame]) -> DataFrame:
    """(what, n): how much there is of everything, and references by kind."""
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame([], "what string, n long")
    for name, df in tables.items():
        out = out.unionAll(df.agg(F.lit(name).alias("what"), F.count("*").alias("n")))
    if "resolved_refs" in tables:
        out = out.unionAll(tables["resolved_refs"].groupBy(F.concat(F.lit("resolved_refs."), F.col("kind")).alias("what")).agg(F.count("*").alias("n")))
    return out
