"""Grading predictions out of sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators.ordered import ordered_pairs


def common_rows(df: DataFrame, systems: Sequence[str], actual: str) -> DataFrame:
    """Rows on which every system and the outcome have a number."""
    return df.dropna(subset=[*systems, actual])


def errors(df: DataFrame, systems: Sequence[str], actual: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, bias and n of each system on common rows, by group and over all where ``by`` is given."""
    long = common_rows(df, systems, actual).select(*by, F.col(actual).alias("__y"), F.inline(F.array(*[F.struct(F.lit(s).alias("system"), F.col(s).cast("double").alias("__p")) for s in systems])))
    d = F.col("__p") - F.col("__y")
    groups = long.groupBy("system", *by) if not by else long.groupingSets([["system", *by], ["system"]], "system", *by)
    return groups.agg(F.count(F.lit(1)).alias("n"), (F.sum(F.abs(d)) / F.count(F.lit(1))).alias("mae"), F.sqrt(F.sum(d * d) / F.count(F.lit(1))).alias("rmse"), (F.sum(d) / F.count(F.lit(1))).alias("bias"))


def pairwise_exact(df: DataFrame, systems: Sequence[str], actual: str, by: Sequence[str], entity: str) -> DataFrame:
    """Share of pairs within a group that each system puts in the order of the outcome.

    Pairs with equal outcomes are left out; a tie in the prediction is a miss.
    For groups of bounded size (a position in a week).
    """
    a, b = df.alias("a"), df.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in by]
    on = F.col(f"a.{entity}") < F.col(f"b.{entity}")
    for s in same:
        on = on & s
    way = F.signum(F.col(f"a.{actual}") - F.col(f"b.{actual}"))
    pairs = a.join(b, on).where(way != 0)
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), *[(F.count_if(F.signum(F.col(f"a.{s}") - F.col(f"b.{s}")) == way) / F.count(F.lit(1))).alias(s) for s in systems])


def pairwise(df: DataFrame, system: str, actual: str, by: Sequence[str], levels: int = 24) -> DataFrame:
    """The same share for groups of any size, without pairs (see ``ordered_pairs``); ``levels`` no longer bounds them and is only accepted."""
    found = ordered_pairs(df.dropna(subset=[system, actual]), by, [system], actual)
    return found.select(*by, "pairs", "right", F.when(F.col("pairs") > 0, F.col("right") / F.col("pairs")).alias("accuracy"))


def pairs_over(df: DataFrame, systems: Sequence[str], actual: str, by: Sequence[str], gap: float = 0.0) -> DataFrame:
    """For each group and system: pairs whose outcomes differ by more than ``gap``, and how many the system puts in their order (see ``ordered_pairs``)."""
    found = ordered_pairs(common_rows(df, systems, actual), by, systems, actual, gap)
    return found.select(*by, F.get(F.array(*[F.lit(s) for s in systems]), F.col("system")).alias("system"), "pairs", "right")


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Rank correlation with average ranks, by group."""
    both = df.dropna(subset=[x, y])
    from panelyard.operators.estimators import simple_fit
    from panelyard.operators.panels import ranks

    both = ranks(ranks(both, by, F.col(x), "__a"), by, F.col(y), "__b")
    twice = lambda r, c: F.col(r) * 2 + F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1  # noqa: E731  twice the average rank
    return simple_fit(both.withColumn("__a", twice("__a", x)).withColumn("__b", twice("__b", y)), by, "__a", "__b").select(*by, F.col("n").cast("long").alias("n"), F.col("r").alias("rho"))


def probability_scores(df: DataFrame, p: str, won: str, by: Sequence[str] = ()) -> DataFrame:
    """Brier score and clipped log loss, and how often favourites were said to win and won."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    y = F.col(won).cast("double")
    fav = F.greatest(q, 1 - q)
    right = F.when(q >= 0.5, y).otherwise(1 - y)
    n = F.count(F.lit(1))
    return df.dropna(subset=[p, won]).groupBy(*by).agg(n.alias("n"), (F.sum((q - y) * (q - y)) / n).alias("brier"), (F.sum(-(y * F.log(q) + (1 - y) * F.log(1 - q))) / n).alias("log_loss"), (F.sum(fav) / n).alias("favourite_stated"), (F.sum(right) / n).alias("favourite_won"))


def reliability(df: DataFrame, p: str, won: str, bins: int = 10) -> DataFrame:
    """Stated and observed share by bin of the stated one."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.dropna(subset=[p, won]).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), (F.sum(p) / F.count(F.lit(1))).alias("stated"), (F.sum(F.col(won).cast("double")) / F.count(F.lit(1))).alias("observed"))


def bootstrap(df: DataFrame, cluster: Sequence[str], value: Column, reps: int = 200, seed: int = 1, levels: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Quantiles of the mean under a Poisson(1) bootstrap of clusters.

    Rows are summed to clusters first; a cluster's weight in a repeat follows
    from a hash of both, so reruns agree and nothing is drawn on the driver.
    """
    sums = df.groupBy(*cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    many = sums.select(*cluster, "s", "n", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    u = F.pmod(F.xxhash64(F.lit(seed), "rep", *cluster), F.lit(1 << 30)) / float(1 << 30)
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    w = sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    per = many.groupBy("rep").agg((F.sum(w * F.col("s")) / F.sum(w * F.col("n"))).alias("m"))
    return per.agg(F.count("m").alias("reps"), *[F.percentile("m", F.lit(q)).alias(f"q{int(q * 100):02d}") for q in levels])


def decisions(comparisons: DataFrame, actuals: DataFrame, key: Sequence[str], entity: str, value: str) -> DataFrame:
    """Projected against realised edge of preferring one entity to another; ungraded with a reason where an outcome is missing."""
    a = actuals.select(*key, F.col(entity).alias("preferred"), F.col(value).alias("__a"))
    b = actuals.select(*key, F.col(entity).alias("other"), F.col(value).alias("__b"))
    j = comparisons.join(a, [*key, "preferred"], "left").join(b, [*key, "other"], "left")
    edge = F.col("__a") - F.col("__b")
    return j.withColumn("realised_edge", edge).withColumn("verdict", F.when(F.col("__a").isNull() | F.col("__b").isNull(), "ungraded: no outcome").when(edge > 0, "right").when(edge < 0, "wrong").otherwise("even")).drop("__a", "__b")


def better_in_every_fold(folds: DataFrame, by: Sequence[str], candidate: Sequence[str], base: Sequence[str], higher: Sequence[bool]) -> DataFrame:
    """Whether the candidate beats the base on every measure in every fold."""
    wins = None
    for c, b, up in zip(candidate, base, higher, strict=True):
        w = F.col(c) > F.col(b) if up else F.col(c) < F.col(b)
        wins = w if wins is None else wins & w
    return folds.groupBy(*by).agg(F.count(F.lit(1)).alias("folds"), F.bool_and(wins).alias("accepted"))


def reconcile(a: DataFrame, b: DataFrame, key: Sequence[str], x: str, y: str, near: float = 1.0) -> DataFrame:
    """Two scorings of the same rows: exact, near, mean error and bias."""
    d = F.col(x) - F.col(y)
    n = F.count(F.lit(1))
    return a.join(b, list(key)).agg(n.alias("n"), (F.count_if(d == 0) / n).alias("exact"), (F.count_if(F.abs(d) <= near) / n).alias("near"), (F.sum(F.abs(d)) / n).alias("mae"), (F.sum(d) / n).alias("bias"))


def ranked_above(mine: DataFrame, free: DataFrame, category: str, rank: str, entity: str) -> DataFrame:
    """For each of mine, how many free ones of its category rank above it: one order over both, no pairs and no category in one task."""
    from panelyard.operators.panels import running_sums

    both = mine.select(category, rank, entity, F.lit(0).alias("__free")).unionByName(free.select(category, rank, entity, F.lit(1).alias("__free")))
    # Of equal ranks mine come first, so free ones of the same rank are not above them.
    return running_sums(both, [category], F.col(rank), ["__free"], {"above": F.col("__free")}).where("__free = 0").select(category, entity, rank, "above")


def band_table(df: DataFrame, band: Column, systems: Sequence[str], actual: str) -> DataFrame:
    """n and bias of each system by band."""
    n = F.count(F.lit(1))
    return df.dropna(subset=[*systems, actual]).groupBy(band.alias("band")).agg(n.alias("n"), *[(F.sum(F.col(s) - F.col(actual)) / n).alias(f"{s}_bias") for s in systems])
