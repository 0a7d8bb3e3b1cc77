"""Estimators: shrinkage, ridge by Gram sums, median lines, grids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def simple_fit(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Correlation, slope and intercept of each group from five sums."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    a, b = F.col(x).cast("double") if dict(df.dtypes)[x] == "double" else F.col(x), F.col(y)
    s = both.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(a).cast("double").alias("sx"), F.sum(b).cast("double").alias("sy"), F.sum(a * a).cast("double").alias("sxx"), F.sum(b * b).cast("double").alias("syy"), F.sum(a * b).cast("double").alias("sxy"))
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    vx, vy, cov = n * sxx - sx * sx, n * syy - sy * sy, n * sxy - sx * sy
    slope = F.when(vx > 0, cov / vx)
    return s.select(*by, "n", F.when((vx > 0) & (vy > 0), cov / (F.sqrt(vx) * F.sqrt(vy))).alias("r"), slope.alias("slope"), ((sy - slope * sx) / n).alias("intercept"))


def gram(df: DataFrame, by: Sequence[str], cols: Sequence[str], target: str) -> DataFrame:
    """All sums of products of (1, cols, target) by group: one map-side combined aggregation, (k+2)^2 / 2 numbers a group."""
    names = ["1", *cols, target]
    value = {c: F.lit(1.0) if c == "1" else F.col(c).cast("double") for c in names}
    return df.groupBy(*by).agg(*[F.sum(value[a] * value[b]).alias(f"s_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j])


def ridge_from_gram(rows: list, cols: Sequence[str], lam: float = 5.0) -> list[dict]:
    """Standardised ridge from summed products: z by sample deviation, the intercept not penalised.

    ``rows`` are gram rows as dicts; returns means, deviations and weights of each.
    """
    import numpy as np

    out, k = [], len(cols)
    for r in rows:
        g = np.array([[r[f"s_{min(i, j)}_{max(i, j)}"] for j in range(k + 2)] for i in range(k + 2)], dtype=float)
        n = g[0, 0]
        mean = g[0, 1 : k + 1] / n
        cross = g[1 : k + 1, 1 : k + 1] - n * np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cross), 0) / max(n - 1, 1))
        use = np.where(sd > 0, sd, 1.0)
        zz = cross / np.outer(use, use)
        zy = (g[1 : k + 1, k + 1] - mean * g[0, k + 1]) / use
        beta = np.linalg.solve(zz + lam * np.eye(k), zy) if k else np.zeros(0)
        out.append({"n": n, "mean": mean, "sd": use, "beta": np.where(sd > 0, beta, 0.0), "intercept": g[0, k + 1] / n})
    return out


def ridge_fit(df: DataFrame, by: Sequence[str], cols: Sequence[str], target: str, lam: float = 5.0) -> DataFrame:
    """A parameter row for each group and column: ``fill`` (training mean), ``mu``, ``sd``, ``beta``, and the intercept under ``(1)``.

    Nulls are filled with the group's mean first. Only (k+2)^2 sums a group come
    to the driver, so the number of groups must be parameter-sized.
    """
    whole = df.where(F.col(target).isNotNull())
    w = Window.partitionBy(*by)
    means = whole.groupBy(*by).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols])
    filled = whole.join(means, list(by)).select(*by, target, *[F.coalesce(F.col(c).cast("double"), F.col(f"__m_{c}"), F.lit(0.0)).alias(c) for c in cols])
    rows = [r.asDict() for r in gram(filled, by, cols, target).collect()]
    out = []
    for r, fit in zip(rows, ridge_from_gram(rows, cols, lam), strict=True):
        key = tuple(r[b] for b in by)
        out.append((*key, "(1)", 0.0, 0.0, 1.0, float(fit["intercept"])))
        out += [(*key, c, float(m), float(m), float(s), float(b)) for c, m, s, b in zip(cols, fit["mean"], fit["sd"], fit["beta"], strict=True)]
    kinds = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by)
    return df.sparkSession.createDataFrame(out, f"{kinds}, col string, fill double, mu double, sd double, beta double")


def ridge_predict(df: DataFrame, params: DataFrame, by: Sequence[str], cols: Sequence[str], name: str = "predicted") -> DataFrame:
    """Fill, standardise and add up, as one generated expression; parameters are one row a group."""
    wide = params.groupBy(*by).agg(*[F.max(F.when(F.col("col") == c, F.struct("fill", "mu", "sd", "beta"))).alias(f"__p_{i}") for i, c in enumerate(["(1)", *cols])])
    total = reduce(lambda a, b: a + b, [(F.coalesce(F.col(c).cast("double"), F.col(f"__p_{i}.fill")) - F.col(f"__p_{i}.mu")) / F.col(f"__p_{i}.sd") * F.col(f"__p_{i}.beta") for i, c in enumerate(cols, 1)], F.col("__p_0.beta"))
    return df.join(wide, list(by), "left").withColumn(name, total).drop(*[f"__p_{i}" for i in range(len(cols) + 1)])


def season_folds(df: DataFrame, by: Sequence[str], season: str, cols: Sequence[str], target: str, lam: float = 5.0) -> DataFrame:
    """Leave-one-season-out predictions: each season's Gram sums are taken from the total, so data is summed once."""
    k = len(cols) + 2
    sums = gram(df.dropna(subset=[*cols, target]), [*by, season], cols, target)
    names = [f"s_{i}_{j}" for i in range(k) for j in range(k) if i <= j]
    w = Window.partitionBy(*by)
    rest = sums.select(*by, season, *[(F.sum(c).over(w) - F.col(c)).alias(c) for c in names])
    rows = [r.asDict() for r in rest.where("s_0_0 > 1").collect()]  # seasons x groups x (k+2)^2 numbers
    out = []
    for r, fit in zip(rows, ridge_from_gram(rows, cols, lam), strict=True):
        key = tuple(r[b] for b in [*by, season])
        out.append((*key, "(1)", 0.0, 0.0, 1.0, float(fit["intercept"])))
        out += [(*key, c, float(m), float(m), float(s), float(b)) for c, m, s, b in zip(cols, fit["mean"], fit["sd"], fit["beta"], strict=True)]
    kinds = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in [*by, season])
    params = df.sparkSession.createDataFrame(out, f"{kinds}, col string, fill double, mu double, sd double, beta double")
    return ridge_predict(df, params, [*by, season], cols)


def median_line(df: DataFrame, x: str, y: str, rounds: int = 25, least: float = 1e-4) -> tuple[float, float]:
    """Least absolute deviations of y on x by reweighted least squares: five sums a round."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    a, b, weight = 0.0, 1.0, F.lit(1.0)
    for k in range(rounds):
        w = weight
        s = rows.agg(F.sum(w).alias("w"), F.sum(w * F.col("x")).alias("x"), F.sum(w * F.col("y")).alias("y"), F.sum(w * F.col("x") * F.col("x")).alias("xx"), F.sum(w * F.col("x") * F.col("y")).alias("xy")).first()
        det = s["w"] * s["xx"] - s["x"] ** 2 if s["w"] else 0.0
        if not det:
            return a, b
        nb = (s["w"] * s["xy"] - s["x"] * s["y"]) / det
        na = (s["y"] - nb * s["x"]) / s["w"]
        if k and abs(na - a) + abs(nb - b) < 1e-9:
            return na, nb
        a, b = na, nb
        weight = 1.0 / F.greatest(F.abs(F.col("y") - F.lit(a) - F.lit(b) * F.col("x")), F.lit(least))
    return a, b


def split_half_n0(df: DataFrame, entity: str, odd: Column, x: str) -> DataFrame:
    """Prior size from the correlation of entities' odd and even halves."""
    halves = df.groupBy(entity).agg(F.avg(F.when(odd, F.col(x))).alias("a"), F.avg(F.when(~odd, F.col(x))).alias("b"), F.count(x).alias("n")).dropna()
    return halves.agg(F.corr("a", "b").alias("r"), F.avg("n").alias("n")).withColumn("n0", F.when(F.col("r") > 0, F.col("n") / 2 * (1 - F.col("r")) / F.col("r")))


def moments_n0(sums: DataFrame, x: str, n: str) -> DataFrame:
    """Prior mean and size of rates x / n by the method of moments."""
    m = sums.agg((F.sum(x) / F.sum(n)).alias("mean"), F.var_samp(F.col(x) / F.col(n)).alias("var"), F.avg(n).alias("size"))
    within = F.col("mean") * (1 - F.col("mean")) / F.col("size")
    between = F.col("var") - within
    return m.withColumn("n0", F.when(between > 0, F.col("mean") * (1 - F.col("mean")) / between))


def first_k_vs_rest(facts: DataFrame, entity: str, on: str, x: str, ks: Sequence[int]) -> DataFrame:
    """For each k: correlation of entities' mean over their first k rows with that over the rest."""
    ranked = facts.select(entity, x, F.row_number().over(Window.partitionBy(entity).orderBy(on)).alias("__r"))
    per = ranked.groupBy(entity).agg(*[f for k in ks for f in (F.sum(F.when(F.col("__r") <= k, F.col(x))).alias(f"a{k}"), F.sum(F.when(F.col("__r") > k, F.col(x))).alias(f"b{k}"))], F.count(F.lit(1)).alias("__n"))
    long = per.select(entity, F.inline(F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"a{k}") / k).alias("a"), F.when(F.col("__n") > k, F.col(f"b{k}") / (F.col("__n") - k)).alias("b")) for k in ks]))).dropna()
    return long.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("r"))


def grid_search(df: DataFrame, by: Sequence[str], grid: Sequence[float], loss) -> DataFrame:
    """The grid value with the least mean loss of each group; ties to the smaller value.

    All losses are sums of one aggregation, so rows are read once and not
    multiplied by the grid.
    """
    per = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(loss(F.lit(g))).alias(f"__g{i}") for i, g in enumerate(grid)])
    best = F.array_min(F.array(*[F.struct((F.col(f"__g{i}") / F.col("n")).alias("loss"), F.lit(float(g)).alias("value")) for i, g in enumerate(grid)]))
    return per.select(*by, "n", best.alias("b")).select(*by, "n", "b.value", "b.loss")


def baseline_projection(rows: DataFrame, share: str, share_n: str, prior: str, n0: float, volume: str, efficiency: str, multiplier: Column, cv: Column, floor: float = 1.5) -> DataFrame:
    """Share shrunk to its role's prior x volume x efficiency x line multiplier, with a spread and a reason.

    Abstains (null) without a prior or a volume.
    """
    own = (F.col(share) * F.col(share_n) + F.col(prior) * n0) / (F.col(share_n) + n0)
    mean = own * F.col(volume) * F.col(efficiency) * multiplier
    reason = F.when(F.col(prior).isNull(), "no role prior").when(F.col(volume).isNull(), "no team volume").when(F.col(efficiency).isNull(), "no efficiency")
    return rows.withColumn("reason", reason).withColumn("projection", F.when(reason.isNull(), mean)).withColumn("spread", F.when(reason.isNull(), F.greatest(mean * cv, F.lit(floor))))


def strength(games: DataFrame, team: str, scored: str, allowed: str, n0: float = 4.0) -> DataFrame:
    """Offense and defense deviations from the league, shrunk."""
    per = games.groupBy(team).agg(F.count(F.lit(1)).alias("n"), F.sum(scored).alias("__s"), F.sum(allowed).alias("__a"))
    w = Window.partitionBy()
    mean = F.sum("__s").over(w) / F.sum("n").over(w)
    return per.select(team, "n", ((F.col("__s") - F.col("n") * mean) / (F.col("n") + n0)).alias("offense"), ((F.col("__a") - F.col("n") * mean) / (F.col("n") + n0)).alias("defense"))


def before_after(facts: DataFrame, entity: str, on: str, x: str, gap: int = 1) -> DataFrame:
    """Mean before and after each break of more than ``gap`` periods, with the difference's t over all breaks."""
    w = Window.partitionBy(entity).orderBy(on)
    rows = facts.withColumn("__brk", (F.col(on) - F.lag(on).over(w) > gap).cast("int")).withColumn("__run", F.sum(F.coalesce("__brk", F.lit(0))).over(w))
    runs = rows.groupBy(entity, "__run").agg((F.sum(x) / F.count(x)).alias("m"))
    pairs = runs.withColumn("before", F.lag("m").over(Window.partitionBy(entity).orderBy("__run"))).dropna().withColumn("d", F.col("m") - F.col("before"))
    return pairs.agg(F.count(F.lit(1)).alias("breaks"), F.avg("d").alias("effect"), (F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count(F.lit(1)).cast("double")))).alias("t"))
