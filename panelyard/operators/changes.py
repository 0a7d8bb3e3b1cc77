"""Differences between dated snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str, label: str, least: float = 1.5) -> DataFrame:
    """Typed changes: added, gone, moved by at least ``least``, relabelled; a key may have several."""
    a = before.select(*keys, F.col(value).alias("v0"), F.col(label).alias("l0"), F.lit(True).alias("in0"))
    b = after.select(*keys, F.col(value).alias("v1"), F.col(label).alias("l1"), F.lit(True).alias("in1"))
    j = a.join(b, list(keys), "full")
    both = F.col("in0") & F.col("in1")
    kind = F.array_compact(F.array(F.when(F.col("in0").isNull(), F.lit("added")), F.when(F.col("in1").isNull(), F.lit("gone")), F.when(both & (F.abs(F.col("v1") - F.col("v0")) >= least), F.lit("moved")), F.when(both & ~F.col("l0").eqNullSafe(F.col("l1")), F.lit("relabelled"))))
    return j.select(*keys, "v0", "v1", "l0", "l1", F.explode(kind).alias("change"))


def comparable(before: DataFrame, after: DataFrame, stamps: Sequence[str]) -> DataFrame:
    """Whether two snapshots may be compared: each stamp has one value, the same in both."""
    one = lambda df, k: df.agg(*[F.when(F.countDistinct(s) == 1, F.max(s).cast("string")).alias(f"{s}_{k}") for s in stamps])
    j = one(before, "a").join(one(after, "b"))
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(f"{s}_a") == F.col(f"{s}_b"), F.lit(False)), F.lit(s)) for s in stamps]))
    return j.select((F.size(bad) == 0).alias("comparable"), bad.alias("differs"))


def source_stamps(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per source: refreshed, unchanged, older or missing."""
    j = before.select("source", F.col("as_of").alias("a")).join(after.select("source", F.col("as_of").alias("b")), "source", "full")
    return j.select("source", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "new").when(F.col("b") > F.col("a"), "refreshed").when(F.col("b") < F.col("a"), "older").otherwise("unchanged").alias("state"))


def settings_diff(before: DataFrame, after: DataFrame, key: str, settings: str) -> DataFrame:
    """Map entries that differ, and whether each was set, unset or changed."""
    flat = lambda df, n: df.select(key, F.explode(settings).alias("setting", n))
    j = flat(before, "old").join(flat(after, "new"), [key, "setting"], "full").where(~F.col("old").eqNullSafe(F.col("new")))
    return j.withColumn("change", F.when(F.col("old").isNull(), "set").when(F.col("new").isNull(), "unset").otherwise("changed"))


def change_feed(snapshots: DataFrame, keys: Sequence[str], at: str, value: str, least: float) -> DataFrame:
    """Each snapshot against the one before it, for a whole history in one pass; added and gone as well as moved.

    Snapshot times are numbered; a key that misses the next number is gone.
    """
    times = snapshots.select(at).distinct().withColumn("__n", F.row_number().over(Window.orderBy(at)))  # snapshot times
    rows = snapshots.join(times, at)
    w = Window.partitionBy(*keys).orderBy("__n")
    was = F.lag("__n").over(w) == F.col("__n") - 1
    rows = rows.withColumn("old", F.when(was, F.lag(value).over(w))).withColumn("__was", F.coalesce(was, F.lit(False))).withColumn("__next", F.lead("__n").over(w))
    last = times.agg(F.max("__n").alias("__last"))
    rows = rows.join(F.broadcast(last))
    came = rows.where(~F.col("__was") & (F.col("__n") > 1)).select(*keys, at, F.lit("added").alias("change"), F.lit(None).cast("double").alias("old"), F.col(value).cast("double").alias("new"))
    moved = rows.where(F.col("__was") & (F.abs(F.col(value) - F.col("old")) >= least)).select(*keys, at, F.lit("moved").alias("change"), F.col("old").cast("double").alias("old"), F.col(value).cast("double").alias("new"))
    left = rows.where((F.col("__n") < F.col("__last")) & (F.coalesce("__next", F.lit(-1)) != F.col("__n") + 1))
    went = left.select(*keys, (F.col("__n") + 1).alias("__n"), F.lit("gone").alias("change"), F.col(value).cast("double").alias("old"), F.lit(None).cast("double").alias("new")).join(times, "__n").select(*keys, at, "change", "old", "new")
    return came.unionByName(moved).unionByName(went)


def visible_events(events: DataFrame, keys: Sequence[str], at: str, state: str, now, hours: int = 48) -> DataFrame:
    """Turns of state within the last hours: a record whose state is not that of the record before it."""
    w = Window.partitionBy(*keys).orderBy(at)
    turn = ~F.col(state).eqNullSafe(F.lag(state).over(w)) & F.lag(at).over(w).isNotNull()
    return events.withColumn("__t", turn).where("__t").drop("__t").where(F.unix_micros(F.col(at)) > F.unix_micros(now) - hours * 3_600_000_000)
