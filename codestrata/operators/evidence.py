"""Source evidence: lines, slices, signatures, comments before a definition, call sites, roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import COMMENT_LINES


def lines_of(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, line_no from 0, text) of files(key, source)."""
    return files.select(key, F.posexplode(F.split("source", "\r?\n")).alias("line_no", "text"))


def roles(operation: str, nodes: DataFrame, ends: tuple[str, ...] = ()) -> DataFrame:
    """nodes with the role that each plays in an answer."""
    if operation == "path":
        role = F.when(F.col("id").isin(*ends), "anchor").otherwise("path")
    elif operation == "impact":
        role = F.when(F.col("distance") == 0, "anchor").otherwise("impacted")
    else:
        role = F.when(F.col("distance") == 0, "anchor").when(F.col("distance") == 1, "direct_neighbor").otherwise("transitive_neighbor")
    return nodes.withColumn("role", role)


def slices(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """nodes with source (their lines) and signature (the first, trimmed); null where the file can't be read."""
    text = files.select("path", F.split("source", "\r?\n").alias("_lines")).hint("merge")  # Spark's guess at the texts' size is no ground for a broadcast
    joined = nodes.join(text, "path", "left")
    inside = F.slice("_lines", F.col("sl") + 1, F.greatest(F.col("el") - F.col("sl") + 1, F.lit(1)))
    return joined.withColumns({"source": F.array_join(inside, "\n"), "signature": F.trim(F.try_element_at("_lines", F.col("sl") + 1))}).drop("_lines")


def preceding_comments(wants: DataFrame, lines: DataFrame, key: str = "path", most: int = COMMENT_LINES) -> DataFrame:
    """
    (key, line_no, comment) for each of wants(key, line_no): the comment above a line, at most `most` lines of it; null where there is none. Blank
    lines between the comment and the line are passed over, one within ends it, as does a line of another kind. `//` and `#` lines count, and lines from
    one that ends in star-slash up to one that begins with slash-star; a line that does both begins such a block like any that ends in star-slash.
    """
    # Of the lines above only `most` can matter, from the last that isn't blank on.
    above = lines.select(key, F.col("line_no").alias("at"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("t"))
    asked = wants.select(key, "line_no").distinct()
    full = above.select(key, "at", F.when(F.col("t") != "", F.col("at")).alias("full"), F.lit(False).alias("asks"))
    before = Window.partitionBy(key).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    full = full.unionByName(asked.select(key, F.col("line_no").alias("at"), F.lit(None).cast("int").alias("full"), F.lit(True).alias("asks"))).withColumn("last", F.max("full").over(before))
    asked = full.where("asks").select(key, F.col("at").alias("line_no"), "last")
    near = asked.where("last is not null").withColumn("at", F.explode(F.sequence(F.greatest(F.col("last") - (most - 1), F.lit(0)), F.col("last")))).drop("last")
    grouped = near.join(above.hint("merge"), [key, "at"]).groupBy(key, "line_no").agg(F.transform(F.reverse(F.sort_array(F.collect_list(F.struct("at", "t")))), lambda x: x["t"]).alias("up"))  # at most `most` lines
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("plain").alias("state"))

    def step(acc, t):
        state = acc["state"]
        closes, block = t.endswith("*/"), state == "block"
        done = (state == "done") | (t == "") | ~(closes | block | t.startswith("//") | t.startswith("#"))
        following = F.when(done, "done").when(closes, "block").when(block & ~t.startswith("/*"), "block").otherwise("plain")
        return F.struct(F.when(done, acc["out"]).otherwise(F.concat(F.array(t), acc["out"])).alias("out"), following.alias("state"))

    text = F.aggregate("up", start, step)["out"]
    found = grouped.select(key, "line_no", F.when(F.size(text) > 0, F.array_join(text, "\n")).alias("comment"))
    return asked.drop("last").join(found.hint("merge"), [key, "line_no"], "left")


#: Word boundaries by ASCII letters, whatever the JVM takes for a letter.
START, END = "(^|[^A-Za-z0-9_])", "($|[^A-Za-z0-9_])"


def skipped_line(text: Column, name: Column) -> Column:
    """Lines that define a name or annotate a parameter with it, and so don't call it."""
    like = lambda before, after: F.regexp_like(text, F.concat(F.lit(before), name, F.lit(after)))
    return like(START + r"(def|function)\s+", END) | like(START + r"class\s+", END) | like("(?i)" + START, r"\s*:\s*(Callable|str|int|float|bool|list|dict|tuple|set|Any|Optional|Union)\b")


def callsites(wants: DataFrame, lines: DataFrame, key: str = "path", tag: tuple[str, ...] = ()) -> DataFrame:
    """(key, tag..., name, line_no, text): the first line of a range that has a name as a word. wants(key, tag..., name, from_line, to_line); names are taken literally."""
    near = wants.join(lines, key).where((F.col("line_no") >= F.col("from_line")) & (F.col("line_no") <= F.col("to_line")))
    # A cheap test first: most lines don't hold the name at all.
    quoted = F.regexp_replace("name", r"([^A-Za-z0-9_])", r"\\$1")
    near = near.where(F.col("text").contains(F.col("name"))).withColumn("_q", quoted)
    near = near.where(F.regexp_like("text", F.concat(F.lit(START), F.col("_q"), F.lit(END))) & ~skipped_line(F.col("text"), F.col("_q")))
    return near.groupBy(key, *tag, "name").agg(F.min("line_no").alias("line_no"), F.min_by("text", "line_no").alias("text"))


def flow_steps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(step, src, dst, kind): call and instantiate edges with both ends present, numbered."""
    ids = nodes.select("id")
    live = edges.where(F.col("kind").isin("call", "instantiate")).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return live.withColumn("step", F.row_number().over(Window.orderBy("edge_seq"))).select("step", "src", "dst", "kind")
