"""Where queries and their SQL are kept, and the panel that most of them read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def instants(df: DataFrame) -> DataFrame:
    """Times without a zone read as instants of the session's zone."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


class Tables:
    """The tables of one folder, read on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return instants(self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))

    @property
    def facts(self) -> DataFrame:
        return facts(self)

    @property
    def months(self) -> DataFrame:
        """The panel by category and period over all seasons: a small table of group totals."""
        return facts(self).groupBy("grp", "cat", "t").agg(F.sum("pts").alias("pts"), F.sum("lines").alias("lines"))


def query(name: str, sql: str | None = None):
    """Registers ``fn(tables)`` under a name, with the DuckDB SQL of the same rows."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir.rstrip("/")))
        if sql is not None:
            body = sql.lstrip()
            if "facts" not in sql:
                SQL[name] = sql
            elif body.upper().startswith("WITH RECURSIVE"):
                SQL[name] = FACTS.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + body[14:].lstrip()
            else:
                SQL[name] = FACTS.rstrip() + ",\n" + body[4:].lstrip() if body[:4].upper() == "WITH" else FACTS + sql
        return fn

    return add


def facts(t: Tables) -> DataFrame:
    """One row for each entity and period: customers by month, with whole-number measures.

    ``entity``, ``grp`` (nation), ``cat`` (segment), ``season`` (year), ``period``
    (month), ``t`` (running month), ``qty``, ``cents``, ``lines``, ``returns`` and
    the score ``pts`` in hundredths. All measures are integers, so sums do not
    depend on the order of rows.
    """
    line = t.lineitem.select("l_orderkey", F.col("l_quantity").cast("long").alias("q"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("c"), (F.col("l_returnflag") == "R").cast("long").alias("r"))
    order = t.orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("period"))
    per = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("entity"), "season", "period").agg(F.sum("q").alias("qty"), F.sum("c").alias("cents"), F.count(F.lit(1)).alias("lines"), F.sum("r").alias("returns"))
    who = t.customer.select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("grp"), F.col("c_mktsegment").alias("cat"))
    score = 4 * F.col("qty") + 50 * F.col("lines") - 200 * F.col("returns")
    return per.join(who, "entity").select("entity", "grp", "cat", "season", "period", (F.col("season") * 12 + F.col("period")).alias("t"), "qty", "cents", "lines", "returns", score.alias("pts"))


FACTS = """
WITH facts AS (
  SELECT o_custkey AS entity, any_value(c_nationkey) AS grp, any_value(c_mktsegment) AS cat, year(o_orderdate)::INT AS season, month(o_orderdate)::INT AS period,
    (year(o_orderdate) * 12 + month(o_orderdate))::INT AS t, sum(l_quantity::BIGINT)::BIGINT AS qty, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents, count(*)::BIGINT AS lines,
    sum((l_returnflag = 'R')::BIGINT)::BIGINT AS returns, (4 * sum(l_quantity::BIGINT) + 50 * count(*) - 200 * sum((l_returnflag = 'R')::BIGINT))::BIGINT AS pts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey, year(o_orderdate), month(o_orderdate))
"""
