"""Scans of source trees: what to take, in which language, and a DataSource that reads it."""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import EXCLUDED, FILES, LANGUAGES

FILES_A_PART = 256


def excluded(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda p: F.lower(p).isin(*EXCLUDED))


def hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.")


def language(path: Column) -> Column:
    ext = F.regexp_extract(F.lower(path), r"\.[^./]*$", 0)
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext]


def language_of(path: str) -> str | None:
    return LANGUAGES.get(os.path.splitext(path)[1].lower())


class IgnoreRules:
    """Rules of an ignore file: the last that fits decides; `!` takes back, a closing slash means folders only. `*` stands within a name, `?` for one character; a rule with a slash counts from the root."""

    def __init__(self, text: str):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in text.splitlines():
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            negate = line.startswith("!")
            line = line[negate:]
            folders = line.endswith("/")
            line = line.rstrip("/")
            body = re.escape(line.lstrip("/")).replace(r"\*\*/", "(.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
            head = "^" if "/" in line else "(^|/)"
            try:
                self.rules.append((re.compile(f"{head}{body}(/|$)"), negate, folders))
            except re.error:
                continue

    def ignores(self, path: str, is_folder: bool) -> bool:
        verdict = False
        for pattern, negate, folders in self.rules:
            if (is_folder or not folders) and pattern.search(path):
                verdict = not negate
        return verdict


def list_files(root: str) -> list[str]:
    """Paths under root that a scan takes, sorted; folders that are left out aren't entered."""
    rules = IgnoreRules("")
    if os.path.exists(at := os.path.join(root, ".gitignore")):
        with open(at, encoding="utf-8", errors="replace") as f:
            rules = IgnoreRules(f.read())
    out = []
    for folder, folders, names in os.walk(root):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        join = lambda n, rel=rel: n if rel == "." else f"{rel}/{n}"
        take = lambda n, d, join=join: n.lower() not in EXCLUDED and not n.startswith(".") and not rules.ignores(join(n), d)
        folders[:] = sorted(d for d in folders if take(d, True))
        out += [join(n) for n in names if take(n, False) and language_of(n)]
    return sorted(out)


class _Part(InputPartition):
    def __init__(self, first: int, paths: list[str]):
        self.first, self.paths = first, paths


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        paths = list_files(self.root)  # names only; the files are read where the parts are
        return [_Part(a, paths[a : a + FILES_A_PART]) for a in range(0, len(paths), FILES_A_PART)] or [_Part(0, [])]

    def read(self, partition):
        rows = []
        for i, path in enumerate(partition.paths):
            full = os.path.join(self.root, path)
            try:
                with open(full, encoding="utf-8", errors="replace", newline="") as f:
                    rows.append((partition.first + i, path, full, language_of(path), f.read()))
            except OSError:
                continue  # an unreadable file is left out
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()), strict=True)], ["file_seq", "path", "abs_path", "lang", "source"])


class SourceTree(DataSource):
    """spark.read.format("source_tree").option("path", folder): the files of a project. The folder must be readable by all executors."""

    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return FILES

    def reader(self, schema):
        return _Reader(os.path.abspath(self.options["path"]))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("path", root).load()

