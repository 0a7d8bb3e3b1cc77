"""Data quality and freshness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def validate(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with every reason. A rule that is null is broken."""
    why = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    judged = df.withColumn("reasons", why)
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def freshness(sources: DataFrame, now: Column, limits: Mapping[str, float]) -> DataFrame:
    """FRESH, STALE or MISSING with the reason and the expiry, by age limits in hours and the period needed."""
    limit = F.coalesce(*[F.when(F.col("source") == k, F.lit(float(v))) for k, v in limits.items()])
    age = (F.unix_micros(now) - F.unix_micros("as_of")) / 3.6e9
    reason = F.when(F.col("as_of").isNull(), "never pulled").when(limit.isNull(), "no limit set").when(age > limit, "too old").when(F.col("last_period") < F.col("needed_period"), "period not covered")
    state = F.when(F.col("as_of").isNull(), "MISSING").when(reason.isNull(), "FRESH").otherwise("STALE")
    return sources.withColumn("state", state).withColumn("reason", reason).withColumn("expires", F.timestamp_micros((F.unix_micros("as_of") + limit * 3.6e9).cast("long")))


def week_phase(games: DataFrame, by: Sequence[str], kickoff: str, done: Column, now: Column) -> DataFrame:
    """PREGAME before the first kickoff, COMPLETE when all games are done, else IN_PROGRESS; and games overdue."""
    late = ~done & (F.unix_micros(F.col(kickoff)) < F.unix_micros(now) - 6 * 3_600_000_000)
    return games.groupBy(*by).agg(F.min(kickoff).alias("first"), F.bool_and(done).alias("final"), F.count_if(late).alias("overdue")).withColumn("phase", F.when(F.col("final"), "COMPLETE").when(F.col("first") > now, "PREGAME").otherwise("IN_PROGRESS"))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def filed(groups: DataFrame, reports: DataFrame, by: Sequence[str], group: str) -> DataFrame:
    """Which groups have filed in each period."""
    have = reports.select(*by, group).distinct().withColumn("__f", F.lit(True))
    return groups.join(have, [*by, group], "left").withColumn("filed", F.coalesce("__f", F.lit(False))).drop("__f")


def forbidden(df: DataFrame, columns: Sequence[str], tokens: Sequence[str]) -> DataFrame:
    """How many rows of each column hold a listed token."""
    pattern = "|".join(rf"\Q{t}\E" for t in tokens)
    return df.agg(*[F.count_if(F.col(c).cast("string").rlike(pattern)).alias(c) for c in columns]).unpivot([], list(columns), "column_name", "rows_found")


def interval_faults(spans: DataFrame, by: Sequence[str], lo: str, hi: str, known: Column) -> DataFrame:
    """Rejected intervals with reasons: reversed, overlapping the one before, unknown code."""
    w = Window.partitionBy(*by).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    why = F.array_compact(F.array(F.when(F.col(hi) < F.col(lo), F.lit("reversed")), F.when(F.max(hi).over(w) >= F.col(lo), F.lit("overlaps")), F.when(~known, F.lit("unknown code"))))
    return spans.withColumn("reasons", why).where(F.size("reasons") > 0)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, with how often."""
    x = a.exceptAll(b.select(*a.columns)).withColumn("only_in", F.lit("a"))
    return x.unionByName(b.select(*a.columns).exceptAll(a).withColumn("only_in", F.lit("b"))).groupBy(*a.columns, "only_in").agg(F.count(F.lit(1)).alias("n"))
