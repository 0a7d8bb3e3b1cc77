"""Model selection and the projections built on fitted parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators.estimators import gram, grid_search, ridge_from_gram, ridge_predict


def override(rows: DataFrame, mean: str, spread: str, withheld: Column) -> DataFrame:
    """0 for those not playing, with the model's own mean kept beside it."""
    return rows.withColumn("model_mean", F.col(mean)).withColumn(mean, F.when(withheld, 0.0).otherwise(F.col(mean))).withColumn(spread, F.when(withheld, 0.0).otherwise(F.col(spread)))


def stack(model: Column, outside: Column, weight: float, intercept: float, slope: float) -> Column:
    """A blend of the model and an outside number on the calibration line; the model alone where there is none outside."""
    return F.when(outside.isNull(), model).otherwise(intercept + slope * (weight * model + (1 - weight) * outside))


def uncalibrated(value: Column, intercept: float, slope: float) -> Column:
    return (value - intercept) / slope


def composed(first: Mapping[str, float], second_intercept: float, second_slope: float) -> dict[str, float]:
    """One affine model for a line applied to an affine model: weights by name, the intercept under ``(1)``."""
    return {k: second_slope * v + (second_intercept if k == "(1)" else 0.0) for k, v in first.items()}


def sweep(df: DataFrame, by: Sequence[str], season: str, cols: Sequence[str], target: str, lambdas: Sequence[float]) -> DataFrame:
    """Held-out squared error of each penalty by group, leaving one season out: data is summed once, errors come from the sums alone."""
    k = len(cols) + 2
    names = [f"s_{i}_{j}" for i in range(k) for j in range(k) if i <= j]
    sums = gram(df.dropna(subset=[*cols, target]), [*by, season], cols, target)
    w = Window.partitionBy(*by)
    both = sums.select(*by, season, *names, *[(F.sum(c).over(w) - F.col(c)).alias(f"r_{c}") for c in names]).collect()
    out = []
    for row in both:
        r = row.asDict()
        rest = {c: r[f"r_{c}"] for c in names}
        if rest["s_0_0"] < 2:
            continue
        g = np.array([[r[f"s_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
        for lam in lambdas:
            fit = ridge_from_gram([rest], cols, lam)[0]
            b = fit["beta"] / fit["sd"]
            v = np.array([fit["intercept"] - b @ fit["mean"], *b, -1.0])
            out.append((*[r[c] for c in by], float(lam), float(g[0, 0]), float(v @ g @ v)))
    kinds = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by)
    e = df.sparkSession.createDataFrame(out, f"{kinds}, penalty double, n double, sse double")
    return e.groupBy(*by, "penalty").agg(F.sum("n").cast("long").alias("n"), (F.sum("sse") / F.sum("n")).alias("mse"))


def ablation(df: DataFrame, by: Sequence[str], season: str, sets: Mapping[str, Sequence[str]], target: str, lam: float = 5.0) -> DataFrame:
    """Held-out squared error of each feature set on the rows that all of them can use."""
    every = list(dict.fromkeys(c for cs in sets.values() for c in cs))
    rows = df.dropna(subset=[*every, target])
    parts = [sweep(rows, by, season, cs, target, [lam]).select(F.lit(name).alias("features"), *by, "n", "mse") for name, cs in sets.items()]
    return reduce(DataFrame.unionByName, parts)


def blend_sweep(df: DataFrame, by: Sequence[str], a: str, b: str, actual: str, weights: Sequence[float]) -> DataFrame:
    """The weight of ``a`` against ``b`` with the least absolute error."""
    return grid_search(df.dropna(subset=[a, b, actual]), by, weights, lambda w: F.abs(F.col(actual) - w * F.col(a) - (1 - w) * F.col(b)))


def held_out_line(df: DataFrame, by: Sequence[str], fold: str, x: str, y: str) -> DataFrame:
    """Skill of a line fitted on the other folds over their mean, by group and fold: all from one set of sums."""
    s = df.dropna(subset=[x, y]).groupBy(*by, fold).agg(*[F.sum(e.cast("double")).alias(n) for n, e in (("n", F.lit(1)), ("sx", F.col(x)), ("sy", F.col(y)), ("xx", F.col(x) * F.col(x)), ("xy", F.col(x) * F.col(y)), ("yy", F.col(y) * F.col(y)))])
    w = Window.partitionBy(*by)
    r = s.withColumns({f"r_{c}": F.sum(c).over(w) - F.col(c) for c in ("n", "sx", "sy", "xx", "xy")})
    det = F.col("r_n") * F.col("r_xx") - F.col("r_sx") * F.col("r_sx")
    b = F.when(det > 0, (F.col("r_n") * F.col("r_xy") - F.col("r_sx") * F.col("r_sy")) / det)
    r = r.withColumn("b", b).withColumn("a", (F.col("r_sy") - F.col("b") * F.col("r_sx")) / F.col("r_n")).withColumn("m", F.col("r_sy") / F.col("r_n"))
    sse = F.col("yy") + F.col("n") * F.col("a") * F.col("a") + F.col("b") * F.col("b") * F.col("xx") - 2 * F.col("a") * F.col("sy") - 2 * F.col("b") * F.col("xy") + 2 * F.col("a") * F.col("b") * F.col("sx")
    base = F.col("yy") - 2 * F.col("m") * F.col("sy") + F.col("n") * F.col("m") * F.col("m")
    return r.select(*by, fold, F.col("n").cast("long").alias("n"), F.col("a").alias("intercept"), F.col("b").alias("slope"), F.when(base > 0, 1 - sse / base).alias("skill"))


def boosted(train: DataFrame, test: DataFrame, cols: Sequence[str], target: str, trees: int = 20, depth: int = 4, seed: int = 1) -> DataFrame:
    """Gradient-boosted trees as a comparator."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    to = VectorAssembler(inputCols=list(cols), outputCol="__f", handleInvalid="keep")
    model = GBTRegressor(featuresCol="__f", labelCol=target, predictionCol="boosted", maxIter=trees, maxDepth=depth, seed=seed).fit(to.transform(train.dropna(subset=[target, *cols])))
    return model.transform(to.transform(test.dropna(subset=list(cols)))).drop("__f")


def super_learner(oof: DataFrame, bases: Sequence[str], target: str, season: str, by: Sequence[str], lam: float = 1.0) -> DataFrame:
    """Out-of-fold base predictions into a small ridge, itself leaving one season out."""
    from panelyard.operators.estimators import season_folds

    return season_folds(oof, by, season, bases, target, lam).withColumnRenamed("predicted", "stacked")


def gamma_shapes(df: DataFrame, by: str, x: str) -> DataFrame:
    """Gamma shape of each stat by maximum likelihood, from two sums (log of the mean less the mean of logs)."""
    s = df.where(F.col(x) > 0).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.avg(F.log(x)).alias("lm"))
    d = F.log("mean") - F.col("lm")
    return s.select(by, "n", "mean", F.when(d > 0, (3 - d + F.sqrt((d - 3) * (d - 3) + 24 * d)) / (12 * d)).alias("shape"))


def nb_size(df: DataFrame, by: str, x: str) -> DataFrame:
    """Negative-binomial size by moments; null where counts spread no more than a Poisson's."""
    s = df.groupBy(by).agg(F.avg(x).alias("mean"), F.var_samp(x).alias("var"))
    return s.withColumn("size", F.when(F.col("var") > F.col("mean"), F.col("mean") * F.col("mean") / (F.col("var") - F.col("mean"))))


def rest_of_season(rates: DataFrame, schedule: DataFrame, slopes: Mapping[str, float], reserve: DataFrame) -> DataFrame:
    """Entity x remaining week: rate plus slope x matchup, 0 on byes and while on reserve, unknown weeks counted; with sums and the weekly list."""
    grid = rates.join(schedule, "team")
    slope = F.coalesce(*[F.when(F.col("category") == k, F.lit(v)) for k, v in slopes.items()], F.lit(0.0))
    grid = grid.join(reserve, "entity", "left")
    value = F.when(F.col("state") == "bye", 0.0).when(F.coalesce(F.col("week") < F.col("back_in_week"), F.lit(False)), 0.0).when(F.col("state") == "game", F.col("rate") + slope * F.coalesce("matchup", F.lit(0.0)))
    return grid.withColumn("value", value).groupBy("entity", "category").agg(F.sum("value").alias("total"), F.count_if(F.col("state") == "game").alias("games"), F.count_if(F.col("value").isNull()).alias("unknown"), F.array_sort(F.collect_list(F.struct("week", "opponent", "value"))).alias("weeks"))


def future_matchups(schedule: DataFrame, strength: DataFrame, mean: float, edge: float = 0.9) -> DataFrame:
    """Expected points of every remaining week from both teams' strengths and the home edge."""
    own = strength.select("team", F.col("offense").alias("__o"))
    opp = strength.select(F.col("team").alias("opponent"), F.col("defense").alias("__d"))
    return schedule.join(own, "team", "left").join(opp, "opponent", "left").withColumn("implied", mean + F.col("__o") + F.col("__d") + F.when(F.col("is_home") == 1, edge).otherwise(-edge)).drop("__o", "__d")


def matchup_slopes(params: DataFrame, col: str) -> DataFrame:
    """Points per unit of a matchup column, out of a fitted ridge."""
    return params.where(F.col("col") == col).withColumn("slope", F.col("beta") / F.col("sd"))


def market_contender(rates: DataFrame, expected: DataFrame, weights: Mapping[str, float], least: int = 1) -> DataFrame:
    """Own rates with the market's expected stats in their place where there are some; abstains with fewer than ``least``."""
    wide = expected.groupBy("entity").pivot("stat", list(weights)).agg(F.max("expected").alias("e"))
    j = rates.join(wide.select("entity", *[F.col(s).alias(f"__{s}") for s in weights]), "entity", "left")
    used = reduce(lambda a, b: a + b, [F.col(f"__{s}").isNotNull().cast("int") for s in weights])
    points = reduce(lambda a, b: a + b, [F.lit(w) * F.coalesce(F.col(f"__{s}"), F.col(s), F.lit(0.0)) for s, w in weights.items()])
    filled = F.array_compact(F.array(*[F.when(F.col(f"__{s}").isNull(), F.lit(s)) for s in weights]))
    return j.select("entity", used.alias("quoted"), F.when(used >= least, points).alias("points"), filled.alias("from_rates"), F.when(used < least, F.lit("no market")).alias("reason"))


def band_calibration(df: DataFrame, band: Column, predicted: str, actual: str, season: str) -> DataFrame:
    """Mean outcome against prediction by band over earlier seasons, for each season."""
    per = df.dropna(subset=[predicted, actual]).groupBy(band.alias("band"), season).agg(F.sum(predicted).alias("p"), F.sum(actual).alias("a"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("band").orderBy(season).rowsBetween(Window.unboundedPreceding, -1)
    return per.select("band", season, F.sum("n").over(w).alias("n"), (F.sum("a").over(w) / F.sum("p").over(w)).alias("factor"))


def demeaned(col: str, by: Sequence[str]) -> Column:
    """A value less its group's mean, for residual targets."""
    return F.col(col) - F.avg(col).over(Window.partitionBy(*by))


def log_rank_residuals(rows: DataFrame, category: str, rank: str, value: str, fold: str) -> DataFrame:
    """Residuals of value on log rank, each fold's line fitted on the others."""
    r = rows.withColumn("__x", F.log(F.col(rank)))
    lines = held_out_line(r, [category], fold, "__x", value).select(category, fold, "intercept", "slope")
    return r.join(lines, [category, fold]).withColumn("residual", F.col(value) - F.col("intercept") - F.col("slope") * F.col("__x")).drop("__x")


def draft_surplus(picks: DataFrame, pick: str, value: str, half: int = 7, least: int = 5) -> DataFrame:
    """Value over what picks around it returned: a running median over pick numbers, which are few."""
    per = picks.groupBy(pick).agg(F.median(value).alias("__m"), F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy(pick).rowsBetween(-half, half)  # rows: one for each pick number
    curve = per.withColumn("expected", F.when(F.sum("__n").over(w) >= least, F.percentile("__m", F.lit(0.5)).over(w))).select(pick, "expected")
    return picks.join(curve, pick).withColumn("surplus", F.col(value) - F.col("expected"))


def designation_discount(rows: DataFrame, entity: str, season: str, listed: Column, value: str, least: int = 2) -> DataFrame:
    """Mean while listed against other games, entities with at least ``least`` of each."""
    per = rows.groupBy(entity, season).agg(F.count_if(listed).alias("a"), F.count_if(~listed).alias("b"), F.avg(F.when(listed, F.col(value))).alias("x"), F.avg(F.when(~listed, F.col(value))).alias("y")).where((F.col("a") >= least) & (F.col("b") >= least))
    return per.agg(F.count(F.lit(1)).alias("entities"), F.avg("x").alias("listed"), F.avg("y").alias("others"), (F.sum("x") / F.sum("y")).alias("ratio"))


def spread_fit(states: DataFrame, grid_a: Sequence[float], grid_b: Sequence[float]) -> DataFrame:
    """The two spread parameters with the least negative log likelihood over a grid; all cells are sums of one pass.

    ``states`` has ``d`` (expected margin), ``f`` (share left), ``proj`` and ``won``.
    """
    from panelyard.functions.scalars import normal_cdf

    cells = [(a, b) for a in grid_a for b in grid_b]

    def nll(a, b):
        p = F.least(F.greatest(normal_cdf(F.col("d") / F.greatest(F.sqrt("f") * (a + b * F.col("proj")), F.lit(1e-6))), F.lit(1e-6)), F.lit(1 - 1e-6))
        return -F.when(F.col("won") == 1, F.log(p)).otherwise(F.log(1 - p))

    s = states.agg(F.count(F.lit(1)).alias("n"), *[F.sum(nll(a, b)).alias(f"c{k}") for k, (a, b) in enumerate(cells)])
    best = F.array_min(F.array(*[F.struct((F.col(f"c{k}") / F.col("n")).alias("nll"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for k, (a, b) in enumerate(cells)]))
    return s.select("n", best.alias("x")).select("n", "x.a", "x.b", "x.nll")


def frozen_holdout(df: DataFrame, by: Sequence[str], cols: Sequence[str], target: str, history: Column, lam: float = 5.0) -> DataFrame:
    """Fitted once on history, used on the rest."""
    from panelyard.operators.estimators import ridge_fit

    return ridge_predict(df.where(~history), ridge_fit(df.where(history), by, cols, target, lam), by, cols)
