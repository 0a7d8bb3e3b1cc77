"""Queries of fitted models: likelihoods, nested blends, fits of every period, residual bands and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.functions.scalars import normal_cdf
from panelyard.operators import blocks, likelihood, nested, resampling
from panelyard.operators.scratch import settled
from panelyard.plans.model_queries import PROJ, projections
from panelyard.plans.registry import Tables, query


def left_of_projections(t: Tables):
    """Residuals of the mean system in hundreds of points, with a share of the period left by entity."""
    p = projections(t).where("sys_mean IS NOT NULL")
    left = (F.col("entity") % 5 + 1) / 5
    return p.select("entity", "t", "cat", "season", left.alias("left"), (F.col("sys_mean") / 100).alias("projected"), ((F.col("actual") - F.col("sys_mean")) / 100 * F.sqrt(left)).alias("residual"))


@query("p5_spread_likelihood")  # iterative; the test holds the result against a search
def p5_fit(t: Tables):
    rows = settled(left_of_projections(t).select("cat", "left", "projected", "residual"), "spread")  # read twice a round
    got = likelihood.spread_likelihood(rows, "cat", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], "residual", "left", "projected")
    return got.select("cat", "n", *[F.round(c, 5).alias(c) for c in ("a", "b", "g", "nll")])


#: Digamma by the asymptotic series ten steps up; the shape where its equation changes sign, by halving.
@query("m22_gamma_likelihood", """
WITH RECURSIVE s AS (SELECT cat, count(*) AS n, avg(pts::DOUBLE) AS mean, ln(avg(pts::DOUBLE)) - avg(ln(pts::DOUBLE)) AS d FROM facts WHERE pts > 0 GROUP BY cat),
h AS (SELECT cat, 0 AS k, -10.0::DOUBLE AS lo, 10.0::DOUBLE AS hi FROM s
  UNION ALL SELECT cat, k + 1, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END FROM (
    SELECT h.*, (lo + hi) / 2 AS mid, exp((lo + hi) / 2) AS x, exp((lo + hi) / 2) + 10 AS y,
      ln(x) - (ln(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * y ** 4) - 1 / (252 * y ** 6) + 1 / (240 * y ** 8)
        - 1 / x - 1 / (x + 1) - 1 / (x + 2) - 1 / (x + 3) - 1 / (x + 4) - 1 / (x + 5) - 1 / (x + 6) - 1 / (x + 7) - 1 / (x + 8) - 1 / (x + 9)) > d AS up
    FROM h JOIN s USING (cat) WHERE k < 70))
SELECT cat, n, round(exp((lo + hi) / 2), 5) AS shape, round(mean / exp((lo + hi) / 2), 4) AS scale FROM h JOIN s USING (cat) WHERE k = 70""")
def m22_likelihood(t: Tables):
    return likelihood.gamma_likelihood(t.facts, ["cat"], "pts").select("cat", "n", F.round("shape", 5).alias("shape"), F.round("scale", 4).alias("scale"))


@query("m22_gamma_bands")  # the shape is a search over inverted distributions; the test repeats it
def m22_bands(t: Tables):
    p = projections(t).where("sys_eb > 0 AND actual > 0")
    got = likelihood.gamma_bands(p, ["cat"], "actual", "sys_eb")
    return got.select("cat", "n", F.round("calibration", 8).alias("calibration"), F.transform("quantiles", lambda q: F.round(q, 8)).alias("quantiles"), F.round("shape", 5).alias("shape"))


@query("m21_residual_bands", """
WITH f AS (SELECT cat, entity % 3 AS band, (pts - 400)::DOUBLE AS v FROM facts), p AS (SELECT unnest(quantile_cont(v, [(k + 0.5) / 20 FOR k IN range(20)])) AS v FROM f),
b AS (SELECT cat, band, count(v) AS n FROM f GROUP BY ALL), u AS (SELECT * FROM f UNION ALL SELECT cat, band, p.v FROM b, p)
SELECT cat, band, n, round(q[1], 6) AS q10, round(q[2], 6) AS q50, round(q[3], 6) AS q90 FROM (SELECT cat, band, quantile_cont(v, [0.1, 0.5, 0.9]) AS q FROM u GROUP BY ALL) JOIN b USING (cat, band)""")
def m21_bands(t: Tables):
    f = t.facts.select("cat", (F.col("entity") % 3).alias("band"), (F.col("pts") - 400).alias("v"))
    got = likelihood.residual_bands(f, ["cat", "band"], "v", [0.1, 0.5, 0.9])
    return got.select("cat", "band", "n", *[F.round(F.get("quantiles", F.lit(k)), 6).alias(f"q{q}") for k, q in enumerate((10, 50, 90))])


BASES = {"direct": (["sys_mean", "sys_recent"], None), "over": (["sys_recent", "sys_eb"], "sys_mean")}
MIX = {"sys_mean": 0.25, "over": 0.25, "direct": 0.5}


@query("m20_nested_blend")  # the test refits every fold
def m20_blend(t: Tables):
    p = projections(t).dropna(subset=["sys_mean", "sys_recent", "sys_eb"])
    got = nested.nested_blend(p, ["cat"], "season", BASES, ["sys_mean", "sys_eb"], "actual", MIX)
    return got.select("entity", "t", *[F.round(c, 5).alias(c) for c in ("blend", "mixed", "averaged")], F.round("calibrated", 3).alias("calibrated"))


@query("m33_period_fits")  # the test refits every period
def m33_fits(t: Tables):
    rows = t.facts.select("entity", "cat", "t", F.when(F.col("returns") > 0, F.col("qty")).alias("q"), F.when(F.col("lines") > 1, F.col("lines")).alias("r"), "pts")
    fits = nested.period_fits(rows, ["cat"], "t", ["q", "r"], "pts")
    return nested.period_predictions(rows, fits, ["cat"], "t", ["q", "r"]).select("entity", "t", F.round("predicted", 5).alias("predicted"))


@query("e11_two_level")  # draws are hashes that SQL elsewhere does not have; the test repeats the estimate and checks the interval
def e11_levels(t: Tables):
    p = projections(t).where("sys_mean IS NOT NULL")
    gain = F.abs(F.col("sys_eb") - F.col("actual")) - F.abs(F.col("sys_mean") - F.col("actual"))
    return resampling.two_level_interval(p, ["cat"], ["season", "period"], ["entity"], gain, reps=200)


@query("e11_pairs")
def e11_pairs(t: Tables):
    p = projections(t).where("sys_mean IS NOT NULL AND sys_eb IS NOT NULL")
    return resampling.pairwise_interval(p, ["cat"], ["season", "period"], "entity", ("sys_mean", "sys_eb"), "actual", reps=100)


GRID = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)


def complete_history(t: Tables):
    """Matchups of every period from the entities whose mean is known."""
    rows = projections(t).where("sys_mean IS NOT NULL")
    sides = rows.select("season", "t", F.floor(F.col("grp") / 2).cast("int").alias("game"), (F.col("grp") % 2).alias("side"), F.col("sys_mean").alias("projection"), F.lit(120.0).alias("spread"), "actual")
    return blocks.historical_matchups(sides, ["season", "t", "game"])[0]


@query("p18_calibration_interval")
def p18_interval(t: Tables):
    m = complete_history(t)
    s = F.sqrt(F.col("sd") * F.col("sd") + F.col("sd_b") * F.col("sd_b"))

    def loss(k: float):
        p = F.least(F.greatest(normal_cdf((F.col("mean") - F.col("mean_b")) / (s * k)), F.lit(1e-6)), F.lit(1 - 1e-6))
        return -(F.col("won") * F.log(p) + (1 - F.col("won")) * F.log(1 - p))

    return resampling.grid_interval(m, ["season", "t"], F.col("season") <= 1995, {k: loss(k) for k in GRID}, 1.0, reps=300)
