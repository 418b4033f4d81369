"""Identities, languages and other functions of names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def symbol_id(path: Column, chain: Column) -> Column:
    return F.concat_ws("::", path, F.array_join(chain, "::"))


def qualified_name(chain: Column) -> Column:
    return F.array_join(chain, ".")


def scope_id(path: Column, kind: Column, sl: Column, sc: Column, el: Column, ec: Column) -> Column:
    return F.concat_ws(":", F.lit("scope"), path, kind, sl, sc, el, ec)


def reference_id(source: Column, raw: Column, sl: Column, sc: Column, el: Column, ec: Column) -> Column:
    return F.concat_ws(":", F.lit("ref"), source, raw, sl, sc, el, ec)


def language_group(path: Column) -> Column:
    """py, java, html, typescript or unknown."""
    ext = F.regexp_extract(F.lower(path), r"\.([^./]*)$", 1)
    return F.when(ext == "py", "py").when(ext == "java", "java").when(ext == "html", "html").when(ext.isin("ts", "tsx", "js", "jsx"), "typescript").otherwise("unknown")


def node_ref(qname: Column, path: Column, line: Column) -> Column:
    return F.concat(qname, F.lit(" ("), path, F.lit(":"), (line + 1).cast("string"), F.lit(")"))
