"""Relational tables seen as a property graph: regions, nations, customers, suppliers, parts, orders and line items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph_from_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges in the engine's schema, with fixed sequence numbers."""
    t = {n: read(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    block = 10**17
    nation = t["nation"].select("n_nationkey", "n_name")

    def node(df, rank, prefix, key, kind, name, path, exported):
        return df.select((F.lit(rank * block) + F.col(key)).alias("node_seq"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(name).alias("name"), F.concat(path, F.lit("."), F.col(name)).alias("qname"), path.alias("path"), exported.alias("exported"))

    yes = F.lit(True)
    orders = t["orders"].withColumn("o_name", F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")))
    nodes = [
        node(t["region"], 0, "r:", "r_regionkey", "package", "r_name", F.col("r_name"), yes),
        node(t["nation"], 1, "n:", "n_nationkey", "module", "n_name", F.col("n_name"), yes),
        node(t["customer"].join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")), 2, "c:", "c_custkey", "class", "c_name", F.col("n_name"), F.col("c_acctbal") > 0),
        node(t["supplier"].join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")), 3, "s:", "s_suppkey", "class", "s_name", F.col("n_name"), F.col("s_acctbal") > 0),
        node(t["part"], 4, "p:", "p_partkey", "interface", "p_name", F.col("p_brand"), yes),
        node(orders, 5, "o:", "o_orderkey", "method", "o_name", F.col("o_orderstatus"), yes),
    ]

    def edge(df, rank, seq, src, dst, kind, method=None):
        made = [F.concat(F.lit(p), F.col(k).cast("string")).alias(a) for a, (p, k) in (("src", src), ("dst", dst))]
        return df.select((F.lit(rank * block) + seq).cast("long").alias("edge_seq"), *made, F.lit(kind).alias("kind"), (F.lit(None).cast("string") if method is None else method).alias("method"))

    method = F.when(F.col("l_returnflag") == "A", "scope").when(F.col("l_returnflag") == "N", "import").otherwise("global_fallback")
    # order and line number come more than once: part and supplier make the number unique (parts below 2**18, suppliers below 2**14)
    line = ((F.col("l_orderkey").cast("long") * 16 + F.col("l_linenumber")) * (1 << 18) + F.col("l_partkey")) * (1 << 14) + F.col("l_suppkey")
    edges = [
        edge(t["nation"], 0, F.col("n_nationkey"), ("r:", "n_regionkey"), ("n:", "n_nationkey"), "owns"),
        edge(t["customer"], 1, F.col("c_custkey"), ("n:", "c_nationkey"), ("c:", "c_custkey"), "owns"),
        edge(t["supplier"], 2, F.col("s_suppkey"), ("n:", "s_nationkey"), ("s:", "s_suppkey"), "owns"),
        edge(t["orders"], 3, F.col("o_orderkey"), ("c:", "o_custkey"), ("o:", "o_orderkey"), "has_member"),
        edge(t["lineitem"], 4, line, ("o:", "l_orderkey"), ("p:", "l_partkey"), "call", method),
        edge(t["lineitem"], 5, line, ("o:", "l_orderkey"), ("s:", "l_suppkey"), "type_use", method),
    ]
    return reduce(DataFrame.unionAll, nodes), reduce(DataFrame.unionAll, edges)
