"""Win probabilities, distributions on lattices, and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.scalars import leverage, normal_cdf, normal_pdf, win_probability
from panelyard.operators.panels import running_sums


def matchups(starters: DataFrame, matchup: str, side: str, mean: str, spread: str) -> DataFrame:
    """One row a matchup: both sides' means and spreads and P(first side wins); null with a reason where a starter has no projection."""
    per = starters.groupBy(matchup, side).agg(F.sum(mean).alias("mean_a"), F.sqrt(F.sum(F.col(spread) * F.col(spread))).alias("sd_a"), F.count_if(F.col(mean).isNull()).alias("__missing"))
    w = Window.partitionBy(matchup).orderBy(side)
    ahead = {c: F.lead(o).over(w) for c, o in (("mean_b", "mean_a"), ("sd_b", "sd_a"), ("__other", "__missing"))}
    two = per.withColumns({**ahead, "__k": F.row_number().over(w)}).where("__k = 1 AND __other IS NOT NULL").withColumn("__gap", F.col("__missing") + F.col("__other"))
    ok, sides = F.col("__gap") == 0, [F.col(c) for c in ("mean_a", "sd_a", "mean_b", "sd_b")]
    return two.select(matchup, *sides, F.when(ok, win_probability(*sides)).alias("p_a"), F.when(ok, leverage(*sides)).alias("leverage"), F.when(~ok, F.concat(F.col("__gap").cast("string"), F.lit(" starters without a projection"))).alias("reason"))


def poisson_binomial(probs: Column) -> Column:
    """Distribution of the number of wins from an array of probabilities."""
    one = F.array(F.lit(1.0))
    zero = F.array(F.lit(0.0))
    return F.aggregate(probs, one, lambda pmf, p: F.zip_with(F.concat(pmf, zero), F.concat(zero, pmf), lambda a, b: a * (1.0 - p) + b * p))


def at_least(pmf: Column, k: Column | int) -> Column:
    """P(at least k)."""
    return F.aggregate(F.slice(pmf, F.lit(k) + 1 if isinstance(k, int) else k + 1, F.size(pmf)), F.lit(0.0), lambda a, x: a + x)


def playoff_probability(rest: Column, this_week: Column, needed: Column) -> Column:
    """P(at least ``needed`` wins) of this week's game and the rest, from the distribution ``rest`` of the rest's wins."""
    k = lambda n: F.greatest(n.cast("int"), F.lit(0))
    return this_week * at_least(rest, k(needed - 1)) + (1.0 - this_week) * at_least(rest, k(needed))


def playoff_leverage(rest: Column, needed: Column) -> Column:
    """What this week's win adds to the playoff probability: P(exactly ``needed`` - 1 wins in the rest), 0 once it is settled."""
    return F.when(needed >= 1, F.coalesce(F.get(rest, (needed - 1).cast("int")), F.lit(0.0))).otherwise(F.lit(0.0))


def live_win_probability(rows: DataFrame, matchup: str, side: str, at: str) -> DataFrame:
    """P(first side wins) at each checkpoint from points so far and what is left.

    ``rows`` has, for each starter, ``now`` (points), ``proj``, ``f`` (share of
    the game left), ``a``, ``b`` and ``g`` of its position: what is left has
    mean f x proj and deviation f^(g/2) (a + b proj), at least 1e-6.
    """
    left_sd = F.pow(F.col("f"), F.col("g") / 2) * (F.col("a") + F.col("b") * F.col("proj"))
    return matchups(rows.withColumn("__m", F.col("now") + F.col("f") * F.col("proj")).withColumn("__s", F.greatest(left_sd, F.lit(1e-6))).withColumn("__key", F.struct(matchup, at)), "__key", side, "__m", "__s").select(f"__key.{matchup}", f"__key.{at}", "p_a")


def points_at(credits: DataFrame, entity: str, elapsed: str, points: str, checkpoints: list[int]) -> DataFrame:
    """Points so far at each checkpoint: one conditional aggregation, no range join."""
    wide = credits.groupBy(entity).agg(*[F.coalesce(F.sum(F.when(F.col(elapsed) <= c, F.col(points))), F.lit(0)).alias(f"c{c}") for c in checkpoints])
    return wide.select(entity, F.inline(F.array(*[F.struct(F.lit(c).alias("checkpoint"), F.col(f"c{c}").alias("so_far")) for c in checkpoints])))


def normal_crps(y: Column, mean: Column, sd: Column) -> Column:
    z = (y - mean) / sd
    return F.when(sd > 0, sd * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 0.5641895835477563)).otherwise(F.abs(y - mean))


def pinball(y: Column, q: Column, level: float) -> Column:
    return F.when(y >= q, level * (y - q)).otherwise((1 - level) * (q - y))


def lattice_crps(pmf: Column, x0: Column, step: Column | float, y: Column) -> Column:
    """CRPS of a distribution on x0, x0 + step, ...: squared gap of the running total to the step at y, a cell at a time, plus what lies outside."""
    start = F.struct(F.lit(0.0).alias("cdf"), F.lit(0.0).alias("total"), x0.cast("double").alias("x"))

    def cell(acc, p):
        cdf, lo = acc["cdf"] + p, acc["x"]
        below = F.least(F.greatest((y - lo) / step, F.lit(0.0)), F.lit(1.0))
        return F.struct(cdf.alias("cdf"), (acc["total"] + step * (below * cdf * cdf + (1 - below) * (1 - cdf) * (1 - cdf))).alias("total"), (lo + step).alias("x"))

    return F.aggregate(pmf, start, cell, lambda acc: acc["total"] + F.greatest(x0 - y, F.lit(0.0)) + F.greatest(y - acc["x"], F.lit(0.0)))


def lattice_quantile(pmf: Column, x0: Column, step: Column | float, level: float) -> Column:
    """The first lattice point at which the running total reaches the level."""
    start = F.struct(F.lit(0.0).alias("cdf"), F.lit(0).alias("n"))
    end = F.aggregate(pmf, start, lambda a, p: F.struct((a["cdf"] + p).alias("cdf"), (a["n"] + F.when(a["cdf"] + p < level - 1e-12, 1).otherwise(0)).alias("n")))
    return x0 + F.least(end["n"], F.size(pmf) - 1) * step


def bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it: inside array functions Spark works out every mention anew."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def discretised_normal(mean: Column, sd: Column, lo: int, hi: int) -> Column:
    """Normal mass of each whole number in [lo, hi], tails in the end cells; each edge's distribution function is worked out once."""
    if lo == hi:
        return F.array(F.lit(1.0))
    edges = F.transform(F.transform(F.sequence(F.lit(lo), F.lit(hi - 1)), lambda k: (k + 0.5 - mean) / sd), lambda z: normal_cdf(z))
    return bound(edges, lambda up: F.zip_with(F.concat(up, F.array(F.lit(1.0))), F.concat(F.array(F.lit(0.0)), up), lambda a, b: a - b))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def poisson_lattice(mean: Column, most: int) -> Column:
    """Poisson mass of 0 to ``most``, what lies above in the last cell: counts of kicks or touchdowns."""
    cells = F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.array(F.exp(-mean)), lambda pmf, k: F.concat(pmf, F.array(F.element_at(pmf, -1) * mean / k))) if most else F.array(F.exp(-mean))
    return bound(cells, lambda c: F.concat(F.slice(c, 1, most), F.array(F.element_at(c, -1) + F.greatest(1.0 - total(c), F.lit(0.0)))))


def compound_lattice(counts: Column, worth: int, rest: Column) -> Column:
    """Distribution of a sum: ``worth`` (1 or more) cells for each of a count, and the rest's own distribution. A cell adds only the counts that reach it."""

    def sums(c: Column, r: Column) -> Column:
        def cell(i: Column) -> Column:
            low = F.greatest(F.ceil((i - F.size(r) + 1) / worth).cast("int"), F.lit(0))
            high = F.least(F.floor(i / worth).cast("int"), F.size(c) - 1)
            held = F.aggregate(F.sequence(low, high), F.lit(0.0), lambda a, k: a + F.get(c, k) * F.get(r, i - k * worth))
            return F.when(low <= high, held).otherwise(0.0)

        return F.transform(F.sequence(F.lit(0), F.size(r) + (F.size(c) - 1) * worth - 1), cell)

    return bound(counts, lambda c: bound(rest, lambda r: sums(c, r)))


def tier_lattice(allowed: Column, tiers: list[tuple[int, float]], rest: float) -> Column:
    """From a distribution of points allowed (from 0 in ones) that of the tier's points: (points, p), tiers of equal points together."""

    def cells(pmf: Column) -> Column:
        out, low = [], -1
        for most, points in [*tiers, (10**6, rest)]:
            out.append(F.struct(F.lit(float(points)).alias("points"), total(F.slice(pmf, low + 2, most - low)).alias("p")))
            low = most
        return F.array_sort(F.array(*out))

    return bound(allowed, cells)


def regridded(pmf: Column, mean: Column) -> Column:
    """A distribution on 0, 1, ... moved to another mean: every cell's mass is split between the two cells where it falls; mass that would leave the grid stays in its end cells.

    A cell inside the grid takes from two cells; only the end cells add up all that would leave.
    """

    def moved(q: Column, move: Column) -> Column:
        whole, n = F.floor(move), F.size(q)
        part = move - whole

        def landed(i: Column, by: Column) -> Column:
            start = F.greatest(F.least(i - by, n), F.lit(0)).cast("int")
            stop = F.greatest(F.least(i - by + 1, n), F.lit(0)).cast("int")
            low, high = F.when(i == 0, 0).otherwise(start), F.when(i == n - 1, n).otherwise(stop)
            return total(F.slice(q, low + 1, high - low))

        return F.transform(q, lambda _, i: (1.0 - part) * landed(i, whole) + part * landed(i, whole + 1))

    return bound(pmf, lambda q: bound(mean - total(F.transform(q, lambda p, k: p * k)), lambda move: moved(q, move)))


def convolved(starters: DataFrame, matchup: str, side: str, pmf: str) -> DataFrame:
    """The distribution of each side's total: starters' whole-number distributions convolved, one bounded group at a time."""

    def add(pdf):
        import numpy as np
        import pandas as pd

        out = np.ones(1)
        for p in pdf[pmf]:
            out = np.convolve(out, p)
        return pd.DataFrame({matchup: [pdf[matchup].iloc[0]], side: [pdf[side].iloc[0]], "pmf": [out.tolist()]})

    kinds = dict(starters.dtypes)
    return starters.select(matchup, side, pmf).groupBy(matchup, side).applyInPandas(add, f"{matchup} {kinds[matchup]}, {side} {kinds[side]}, pmf array<double>")


def beats(totals: DataFrame, matchup: str, side: str) -> DataFrame:
    """P(first side's total is larger), a tie counting half, from the two distributions."""
    w = Window.partitionBy(matchup).orderBy(side)
    two = totals.withColumn("other", F.lead("pmf").over(w)).where("other IS NOT NULL")
    lower = F.aggregate("other", F.struct(F.array().cast("array<double>").alias("c"), F.lit(0.0).alias("t")), lambda a, p: F.struct(F.concat(a["c"], F.array(a["t"] + p / 2)).alias("c"), (a["t"] + p).alias("t")))["c"]
    cells = two.withColumn("lower", lower).select(matchup, F.aggregate(F.transform("pmf", lambda p, i: p * F.coalesce(F.get("lower", i), F.lit(1.0))), F.lit(0.0), lambda a, x: a + x).alias("p_a"))
    return cells


def dealt(rows: DataFrame, reps: int, seed: int, category: str, rank: str, groups: int) -> DataFrame:
    """Ranked rows dealt at random to groups, ``reps`` times: within each category every run of ``groups`` ranks gives one to each."""
    many = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    block = F.floor((F.col(rank) - 1) / groups)
    w = Window.partitionBy("rep", category, block).orderBy(F.xxhash64(F.lit(seed), "rep", category, rank), rank)
    return many.withColumn("dealt_to", F.row_number().over(w))


def best_still_there(players: DataFrame, category: str, value: str, survives: str) -> DataFrame:
    """Expected value of the best one left in each category: each value times its survival and the loss of all above it."""
    lost = running_sums(players, [category], -F.col(value), ["entity"], {"__gone": F.log(F.greatest(1 - F.col(survives), F.lit(1e-300)))})
    return lost.withColumn("__e", F.col(value) * F.col(survives) * F.exp("__gone")).groupBy(category).agg(F.sum("__e").alias("expected_best"))


def completion(counts: DataFrame, needs: dict[str, int], left: str) -> DataFrame:
    """Slots still to fill against picks left: whether a roster can be completed."""
    missing = sum((F.greatest(F.lit(n) - F.coalesce(F.col(p), F.lit(0)), F.lit(0)) for p, n in needs.items()), F.lit(0))
    return counts.withColumn("missing", missing).withColumn("feasible", F.col("missing") <= F.col(left))
