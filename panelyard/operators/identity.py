"""Joins on ids through one crosswalk; what cannot be resolved is a result, never a guess."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_exact(rows: DataFrame, names: DataFrame, key: str, target: str) -> DataFrame:
    """``rows`` with the one ``target`` of their key; null and ``ambiguous`` for several, ``unresolved`` for none."""
    known = names.groupBy(key).agg(F.countDistinct(target).alias("__n"), F.min(target).alias("__t"))
    got = rows.join(known, key, "left")
    basis = F.when(F.coalesce("__n", F.lit(0)) == 0, "unresolved").when(F.col("__n") == 1, "exact").otherwise("ambiguous")
    return got.withColumn("resolved", F.when(F.col("__n") == 1, F.col("__t"))).withColumn("basis", basis).drop("__n", "__t")


def resolution_report(rows: DataFrame, crosswalk: DataFrame, key: str, target: str) -> DataFrame:
    """Counts and shares by status: mapped, blank, unresolved."""
    got = rows.join(crosswalk.select(key, target).dropDuplicates([key]), key, "left")
    status = F.when(F.coalesce(F.col(key).cast("string"), F.lit("")) == "", "blank").when(F.col(target).isNull(), "unresolved").otherwise("mapped")
    counts = got.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("all_rows")))).select("status", "n", (F.col("n") / F.col("all_rows")).alias("share"))


def match_pairs(rows: DataFrame, games: DataFrame, day: str, a: str, b: str, game_id: str) -> DataFrame:
    """The game of a day and an unordered pair; null unless exactly one fits."""
    pair = F.array_sort(F.array(a, b))
    known = games.groupBy(day, pair.alias("__pair")).agg(F.count(F.lit(1)).alias("__n"), F.min(game_id).alias("__g"))
    return rows.withColumn("__pair", pair).join(known, [day, "__pair"], "left").withColumn(game_id, F.when(F.col("__n") == 1, F.col("__g"))).drop("__pair", "__n", "__g")


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that fails when the right side repeats a key."""
    n = F.count(F.lit(1))
    checked = right.groupBy(key).agg(n.alias("__n"), *[F.first(c).alias(c) for c in right.columns if c != key])
    return left.join(checked.withColumn("__ok", F.assert_true(F.col("__n") == 1, F.lit(f"{key} repeats"))).where("__ok IS NULL").drop("__n", "__ok"), key, "left")


def ownership(rows: DataFrame, rosters: DataFrame, entity: str, owner: str, mine) -> DataFrame:
    """MINE, ROSTERED or FREE by the roster that holds the entity."""
    held = rosters.groupBy(entity).agg(F.min(owner).alias("__o"))
    return rows.join(held, entity, "left").withColumn("ownership", F.when(F.col("__o").isNull(), "FREE").when(F.col("__o") == F.lit(mine), "MINE").otherwise("ROSTERED")).drop("__o")
