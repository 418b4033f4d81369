"""Relational tables written as a source tree: a small project in four languages, a file for each region, nation, supplier and some customers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read

REGION = """from flask import Blueprint

routes = Blueprint('r')


class Region%1$d(Base):
    __tablename__ = 'region_%1$d'

    def name(self):
        return 'region'

    def _hidden(self):
        return shared(%1$d)


def shared(n):
    return n
"""
NATION = """import json
from pkg.region_%2$d import Region%2$d, routes
from pkg.region_%2$d import shared as common


class Nation%1$d(Region%2$d):
    def open(self):
        self.close()
        return common(1)

    # closes
    # for good
    def close(self):
        print(json.dumps(1))


@routes.route('/nation/%1$d', methods=['%3$s'])
def run_%1$d():
    it = Nation%1$d()
    it.open()
    missing_%1$d()
"""
SUPPLIER = """import { Vendor } from '../vendor';
import { helper as assist } from './tools.js';

export class Supplier%1$dService implements Vendor {
  private rank: number = %2$d;

  pay(to: Vendor): void {
    this.check();
    assist(%2$d);
  }

  check(): boolean {
    return /[{(]/.test(`${lost%1$d()}`);
  }
}

const one = new Supplier%1$dService();
"""
VENDOR = "export interface Vendor {\n  rank: number;\n}\n"
TOOLS = "export function helper(n: number): number {\n  return n;\n}\n"
CUSTOMER = """package customers;
import customers.Account;
public class Customer%1$d extends Account {
  private Account first;
  public void move(int n) { hold(n); }
  protected void hold(int n) { }
}
"""
ACCOUNT = "package customers;\npublic class Account {\n  public void close() { }\n}\n"
PAGE = """<html>
<head><script src="suppliers/tools.js"></script><link href="style.css"></head>
<body id="part-%1$d"></body>
</html>
"""
BROKEN = "def before():\n    return 1\n\ndef wrong(:\n    pass\n\ndef after():\n    return before()\n"


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_seq, path, abs_path, lang, source), a table of files as a scan would give it."""
    t = {n: read(spark, sf_dir, n) for n in ("region", "nation", "supplier", "customer", "part")}

    def written(df, seq, path, lang, text, *values):
        return df.select(seq.cast("long").alias("file_seq"), path.alias("path"), F.lit(lang).alias("lang"), F.format_string(text, *values).alias("source"))

    r, n, s, c, p = (F.col(k) for k in ("r_regionkey", "n_nationkey", "s_suppkey", "c_custkey", "p_partkey"))
    named = lambda folder, k, ext: F.concat(F.lit(folder), k.cast("string"), F.lit(ext))
    whole = lambda k: k.cast("long")
    some = [
        written(t["region"], r + 100, named("pkg/region_", r, ".py"), "python", REGION, whole(r)),
        written(t["nation"], n + 1000, named("pkg/nation_", n, ".py"), "python", NATION, whole(n), whole(F.col("n_regionkey")), F.when(n % 2 == 0, "POST").otherwise("PUT")),
        written(t["supplier"], s + 10**6, named("suppliers/s_", s, ".ts"), "typescript", SUPPLIER, whole(s), whole(F.col("s_nationkey"))),
        written(t["customer"].where(c % 10 == 0), c + 10**8, named("customers/Customer", c, ".java"), "java", CUSTOMER, whole(c)),
        written(t["part"].where(p % 50 == 0), p + 10**9, named("page_", p, ".html"), "html", PAGE, whole(p)),
        spark.createDataFrame([(1, "vendor.ts", "typescript", VENDOR), (2, "suppliers/tools.ts", "typescript", TOOLS), (3, "customers/Account.java", "java", ACCOUNT), (4, "pkg/broken.py", "python", BROKEN)], "file_seq long, path string, lang string, source string"),
    ]
    return reduce(DataFrame.unionAll, some).select("file_seq", "path", F.concat(F.lit("/"), "path").alias("abs_path"), "lang", "source")
