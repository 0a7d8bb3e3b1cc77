"""Estimates without a closed form: each step's slopes and curvatures are sums over the rows, the step itself a few numbers."""

from __future__ import annotations

from collections.abc import Sequence
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.operators.panels import ranks


def spread_likelihood(states: DataFrame, category: str, categories: Sequence[str], residual: str, left: str, projected: str, rounds: int = 60, tolerance: float = 1e-10) -> DataFrame:
    """Spread of what is left of a projection: residuals are normal with deviation left^(g/2) (a + b projected).

    ``a`` and ``b`` are those of the category and ``g`` of all, by maximum
    likelihood: scoring steps on log a, log b and g, whose gradient and expected
    curvature are sums by category (ten numbers each), so every round is one
    pass of map-side sums. A step is bounded (log a and log b in -5 to 3, g in
    0.3 to 2) and halved until the likelihood rises; all halvings are judged in
    one pass. Projections below 0 count as 0; rows of other categories, with
    nothing left or with a null take no part. A category without rows keeps the
    values that the search begins with. Returns ``category``, ``a``, ``b``, ``g``,
    ``n`` and the mean negative log likelihood ``nll`` over all rows.
    """
    names = list(categories)
    rows = states.where(F.col(category).isin(*names) & (F.col(left) > 0)).select(F.col(category).alias("c"), F.col(residual).cast("double").alias("r"), F.log(F.col(left).cast("double")).alias("lf"), F.greatest(F.col(projected).cast("double"), F.lit(0.0)).alias("p")).dropna()
    k = len(names)

    def of(values):
        return F.element_at(F.create_map(*[x for c, v in zip(names, values, strict=True) for x in (F.lit(c), F.lit(float(v)))]), F.col("c")) if k else F.lit(0.0)

    def deviation(x) -> tuple[Column, Column, Column, Column]:
        a, b = of(np.exp(x[:k])), of(np.exp(x[k : 2 * k]))
        share = F.exp(F.col("lf") * (float(x[-1]) / 2))
        return share * (a + b * F.col("p")) + 1e-6, share * a, share * b * F.col("p"), share * (a + b * F.col("p")) * F.col("lf") / 2

    def loss(x) -> Column:
        sd = deviation(x)[0]
        return F.sum(F.log(sd) + F.col("r") * F.col("r") / (2 * sd * sd) + 0.9189385332046727)

    def slopes(x) -> dict:
        sd, *parts = deviation(x)
        d = [p / sd for p in parts]
        off = 1 - F.col("r") * F.col("r") / (sd * sd)
        sums = [F.count(F.lit(1)).alias("n"), *[F.sum(off * e).alias(f"g{i}") for i, e in enumerate(d)], *[F.sum(2 * d[i] * d[j]).alias(f"h{i}{j}") for i in range(3) for j in range(i, 3)]]
        return {s["c"]: s for s in rows.groupBy("c").agg(*sums).collect()}  # at most one for each of ``categories``

    low, high = np.r_[np.full(2 * k, -5.0), 0.3], np.r_[np.full(2 * k, 3.0), 2.0]
    x = np.r_[np.full(k, np.log(2.0)), np.full(k, np.log(0.4)), 1.0]
    # Where residuals are of another scale than one or two, the search begins there.
    seen = rows.agg(F.count(F.lit(1)), F.stddev_pop("r")).first()
    total = seen[0]
    if total and seen[1]:
        high[: 2 * k] = max(3.0, float(np.log(20 * seen[1])))
        x[:k] = min(max(float(np.log(seen[1])), -5), high[0])
    now = rows.agg(loss(x).alias("l")).first()["l"] if total else None
    counts: dict = {}
    for _ in range(rounds if total else 0):
        sums = slopes(x)
        counts = {c: s["n"] for c, s in sums.items()}
        grad, curve = np.zeros(2 * k + 1), np.zeros((2 * k + 1, 2 * k + 1))
        for i, c in enumerate(names):
            if (s := sums.get(c)) is not None:
                at = [i, k + i, 2 * k]
                grad[at] += [s["g0"], s["g1"], s["g2"]]
                for u in range(3):
                    for v in range(u, 3):
                        curve[at[u], at[v]] += s[f"h{u}{v}"]
                        if u != v:
                            curve[at[v], at[u]] += s[f"h{u}{v}"]
        # What stands at its bound and is pushed beyond has no part in the step.
        free = ~((x <= low) & (grad > 0) | (x >= high) & (grad < 0)) & (np.diag(curve) > 0)
        step = np.zeros(2 * k + 1)
        if free.any():
            own = curve[np.ix_(free, free)]
            step[free] = -np.linalg.lstsq(own + 1e-9 * np.diag(np.diag(own)), grad[free], rcond=None)[0]
        trials = [np.clip(x + step * 0.5**h, low, high) for h in range(12)]
        found = rows.agg(*[loss(t).alias(f"l{h}") for h, t in enumerate(trials)]).first()
        best = min(range(12), key=lambda h: found[f"l{h}"])
        if not found[f"l{best}"] < now - tolerance * abs(now):
            if found[f"l{best}"] < now:
                x, now = trials[best], found[f"l{best}"]
            break
        x, now = trials[best], found[f"l{best}"]
    out = [(c, float(np.exp(x[i])), float(np.exp(x[k + i])), float(x[-1]), int(counts.get(c, 0)), float(now / total) if total else None) for i, c in enumerate(names)]
    return states.sparkSession.createDataFrame(out, f"{category} string, a double, b double, g double, n long, nll double")


# ---- gamma shapes


def digamma(x: Column) -> Column:
    """For x above 0: six steps up by recurrence, then the asymptotic series."""
    y = x + 6
    up = sum((1 / (x + k) for k in range(1, 6)), 1 / x)
    i = 1 / (y * y)
    return F.log(y) - 1 / (2 * y) - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i * (1 / 132 - i * 691 / 32760))))) - up


def trigamma(x: Column) -> Column:
    y = x + 6
    up = sum((1 / ((x + k) * (x + k)) for k in range(1, 6)), 1 / (x * x))
    i = 1 / (y * y)
    return 1 / y + i / 2 + i / y * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i * (1 / 30 - i * (5 / 66 - i * 691 / 2730))))) + up


def gamma_likelihood(df: DataFrame, by: Sequence[str], x: str, rounds: int = 20) -> DataFrame:
    """Gamma shape of each group's positive values by maximum likelihood: ``n``, ``mean``, ``shape``, ``scale``.

    The likelihood needs two sums (log of the mean less the mean of logs); on
    them, Newton steps on the shape run inside one expression. Values at or
    below 0 and nulls are left out; where all values are equal there is no
    greatest likelihood, so the shape is null.
    """
    s = df.where(F.col(x) > 0).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(x).cast("double")).alias("mean"), F.avg(F.log(F.col(x).cast("double"))).alias("__l"))
    d = F.log("mean") - F.col("__l")
    s = s.withColumn("__d", F.when(d > 1e-12, d))
    start = (3 - F.col("__d") + F.sqrt((F.col("__d") - 3) * (F.col("__d") - 3) + 24 * F.col("__d"))) / (12 * F.col("__d"))

    def newton(k: Column, _: Column) -> Column:
        new = 1 / (1 / k + (F.log(k) - digamma(k) - F.col("__d")) / (k * k * (1 / k - trigamma(k))))
        return F.when(new > 0, new).otherwise(k / 2)

    shape = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, newton)
    return s.withColumn("shape", shape).withColumn("scale", F.col("mean") / F.col("shape")).drop("__l", "__d")


def _gamma_p(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function: a series, or a continued fraction for large x."""
    a, x = np.broadcast_arrays(a, np.maximum(x, 1e-300))
    head = np.exp(a * np.log(x) - x - np.vectorize(lgamma)(a))
    term = total = 1 / a
    for n in range(1, 2000):
        term = term * x / (a + n)
        total = total + term
        if np.all((term < 1e-16 * total) | (x >= a + 1)):
            break
    b = x + 1 - a
    c, d = np.full(x.shape, 1e300), 1 / np.where(b == 0, 1e-300, b)
    h = d
    for n in range(1, 2000):
        an, b = -n * (n - a), b + 2
        d = 1 / np.where((v := an * d + b) == 0, 1e-300, v)
        c = np.where((v := b + an / c) == 0, 1e-300, v)
        h = h * d * c
        if np.all((np.abs(d * c - 1) < 1e-15) | (x < a + 1)):
            break
    return np.where(x < a + 1, head * total, 1 - head * h)


def unit_quantile(shape: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Quantiles of a gamma distribution of mean 1, by halving the bracket of the logarithm."""
    shape, q = np.broadcast_arrays(np.asarray(shape, float), np.asarray(q, float))
    low, high = np.full(shape.shape, -400.0), np.full(shape.shape, np.log(60.0))
    for _ in range(90):
        mid = (low + high) / 2
        under = _gamma_p(shape, shape * np.exp(mid)) < q
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return np.exp((low + high) / 2)


def band_shape(quantiles: np.ndarray, band: Sequence[float]) -> np.ndarray:
    """For each row of outcome quantiles, the shape whose unit-mean quantiles are nearest (least squares of logs): golden section on its logarithm, 0.2 to 500."""
    q, target = np.asarray(band, float)[None, :], np.log(quantiles)

    def loss(t):
        return ((np.log(unit_quantile(np.exp(t)[:, None], q)) - target) ** 2).sum(axis=1)

    g = (5**0.5 - 1) / 2
    low, high = np.full(len(target), np.log(0.2)), np.full(len(target), np.log(500.0))
    left, right = high - g * (high - low), low + g * (high - low)
    fl, fr = loss(left), loss(right)
    for _ in range(60):
        down = fl < fr
        low, high = np.where(down, low, left), np.where(down, right, high)
        left_new, right_new = high - g * (high - low), low + g * (high - low)
        fresh = loss(np.where(down, left_new, right_new))
        fl, fr = np.where(down, fresh, fr), np.where(down, fl, fresh)
        left, right = left_new, right_new
    return np.exp((low + high) / 2)


def gamma_bands(df: DataFrame, by: Sequence[str], x: str, expected: str, band: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Gamma shape of outcomes over their expectation by matching quantiles: ``n``, ``calibration`` (mean ratio), ``quantiles`` and ``shape``.

    Outcomes are divided by calibrated expectations, so their mean is 1; exact
    quantiles of each group are read off ranks, however large the group, and
    only one row a group is solved. Rows with a null or without an expectation
    above 0 are left out; a group with a quantile at or below 0 has no shape.
    """
    rows = df.where((F.col(expected) > 0) & F.col(x).isNotNull()).select(*by, (F.col(x) / F.col(expected)).cast("double").alias("__z"))
    scale = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("__z").alias("calibration"))
    held = exact_quantiles(rows.join(scale.where("calibration > 0").select(*by, "calibration"), list(by)).withColumn("__z", F.col("__z") / F.col("calibration")), by, "__z", band)

    @F.pandas_udf("double")
    def solve(q: pd.Series) -> pd.Series:
        values = np.array([np.asarray(v, float) for v in q]).reshape(len(q), len(band))
        good = (values > 0).all(axis=1)
        out = np.full(len(q), np.nan)
        if good.any():
            out[good] = band_shape(values[good], band)
        return pd.Series(out).where(good, None)

    return scale.join(held, list(by), "left").withColumn("shape", F.when(F.col("quantiles").isNotNull(), solve(F.coalesce("quantiles", F.array(*[F.lit(0.0)] * len(band))))))


def exact_quantiles(rows: DataFrame, by: Sequence[str], value: str, levels: Sequence[float]) -> DataFrame:
    """Exact quantiles of each group by straight lines between its ordered values, as ``quantiles``; nulls are left out.

    Values get their ranks in ranges (``panels.ranks``), so no group is one
    task's; only the two rows at each level are kept.
    """
    if not by:
        return exact_quantiles(rows.withColumn("__all", F.lit(0)), ["__all"], value, levels).drop("__all")
    known = rows.where(F.col(value).isNotNull())
    placed = ranks(known.withColumn("__u", F.monotonically_increasing_id()), by, F.col(value), "__r", ["__u"])
    placed = placed.join(known.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")), list(by))
    at = lambda q: (F.col("__n") - 1) * float(q)
    part = lambda q: F.when(F.col("__r") - 1 == F.floor(at(q)), 1 - (at(q) - F.floor(at(q)))).when(F.col("__r") - 1 == F.floor(at(q)) + 1, at(q) - F.floor(at(q)))
    sums = [F.sum(part(q) * F.col(value)).alias(f"__q{k}") for k, q in enumerate(levels)]
    return placed.groupBy(*by).agg(*sums).select(*by, F.array(*[f"__q{k}" for k in range(len(levels))]).alias("quantiles"))


# ---- residual bands


def residual_bands(residuals: DataFrame, band: Sequence[str], residual: str, levels: Sequence[float], prior: int = 20) -> DataFrame:
    """Quantiles of each band's residuals, drawn towards those of all rows: ``n`` and ``quantiles``.

    Beside a band's own residuals stand ``prior`` of all rows', at the middles of
    as many equal shares, each with the weight of one row: a band of few rows
    shows the pooled spread and a large one its own. Quantiles are exact, by
    straight lines between ordered values; bands of any size are ranked in
    ranges. Null residuals are left out; a band of nulls alone shows the pooled
    quantiles with ``n`` 0.
    """
    rows = residuals.select(*band, F.col(residual).cast("double").alias("__v"))
    pooled = exact_quantiles(rows.select("__v"), [], "__v", [(k + 0.5) / prior for k in range(prior)])
    bands = rows.groupBy(*band).agg(F.count("__v").alias("n"))
    added = bands.select(*band).crossJoin(pooled).select(*band, F.explode("quantiles").alias("__v"))  # one row of ``prior`` numbers beside each band
    both = rows.where("__v IS NOT NULL").unionByName(added)
    return bands.join(exact_quantiles(both, band, "__v", levels), list(band))
