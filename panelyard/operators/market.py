"""Price quotes to a market's view: margins taken out, one line a book, one view over books."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.scalars import implied_probability, poisson_cdf
from panelyard.operators.panels import spread

QUOTE = ["event_id", "book", "market", "player"]


def devig(quotes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Main two-way lines with the margin taken out, and counts of what was set aside.

    ``quotes``: event_id, book, market, player, side (Over or Under), point,
    price. A point counts only with exactly one Over and one Under. Of a
    player's points the one with P(over) nearest a half is the main line, the
    lower point on a tie.
    """
    p = implied_probability(F.col("price"))
    over, under = F.col("side") == "Over", F.col("side") == "Under"
    pairs = quotes.groupBy(*QUOTE, "point").agg(F.count(F.lit(1)).alias("n"), F.count_if(over).alias("no"), F.count_if(under).alias("nu"), F.max(F.when(over, p)).alias("qo"), F.max(F.when(under, p)).alias("qu"))
    clean = (F.col("n") == 2) & (F.col("no") == 1) & (F.col("nu") == 1) & F.col("point").isNotNull() & F.col("qo").isNotNull() & F.col("qu").isNotNull()
    judged = pairs.withColumn("ok", clean)
    two = judged.where("ok").select(*QUOTE, "point", (F.col("qo") / (F.col("qo") + F.col("qu"))).alias("p_over"), (F.col("qo") + F.col("qu") - 1.0).alias("overround"))
    ranked = two.withColumn("k", F.row_number().over(Window.partitionBy(*QUOTE).orderBy(F.abs(F.col("p_over") - 0.5), "point")))
    main = ranked.where("k = 1").drop("k").withColumn("method", F.lit("two-way"))
    aside = judged.where("NOT ok").select(F.lit("not one clean pair").alias("reason")).union(ranked.where("k > 1").select(F.lit("alternate line").alias("reason")))
    return main, aside.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def one_sided(yes: DataFrame, two_way: DataFrame) -> DataFrame:
    """Lone Yes quotes scaled by their book's median margin in the same event; null where it has none."""
    margin = two_way.groupBy("event_id", "book").agg(F.median("overround").alias("__m"))
    return spread(yes, "event_id", "book").join(margin, ["event_id", "book"], "left").withColumn("p_yes", implied_probability(F.col("price")) / (1.0 + F.col("__m"))).withColumn("method", F.when(F.col("__m").isNotNull(), "one-sided")).drop("__m")


def consensus(lines: DataFrame) -> DataFrame:
    """Across books: median line and probability, books, methods."""
    return lines.groupBy("event_id", "market", "player").agg(F.median("point").alias("line"), F.median("p_over").alias("p_over"), F.countDistinct("book").alias("books"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"))


def expected_poisson(line: Column, p_over: Column, steps: int = 40) -> Column:
    """The Poisson mean at which P(X > line) is ``p_over``, by bisection in a higher-order function; null outside 0.05-0.95."""
    k = F.floor(line).cast("int")
    start = F.struct(F.lit(0.0).alias("lo"), (line * 4 + 20).cast("double").alias("hi"))
    mid = lambda s: (s["lo"] + s["hi"]) / 2
    high = lambda s: 1.0 - poisson_cdf(k, mid(s)) > p_over
    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: F.struct(F.when(high(s), s["lo"]).otherwise(mid(s)).alias("lo"), F.when(high(s), mid(s)).otherwise(s["hi"]).alias("hi")))
    return F.when(p_over.between(0.05, 0.95), (end["lo"] + end["hi"]) / 2)


def expected_gamma(lines: DataFrame, line: str, p_over: str, shape: str, name: str = "expected") -> DataFrame:
    """The mean of a gamma count of known shape with P(X > line) = p, solved a column at a time in an Arrow UDF."""

    @F.pandas_udf("double")
    def solve(x: pd.Series, p: pd.Series, k: pd.Series) -> pd.Series:
        x, p, k = (s.to_numpy(dtype=float) for s in (x, p, k))
        u, w = np.polynomial.legendre.leggauss(64)

        def upper(scale):  # P(X > x) by quadrature over the lower tail in v = t^k
            t = (u[None, :] + 1) / 2
            z = np.power(t, 1 / k[:, None]) * (x / scale)[:, None]
            norm = np.array([lgamma(a) for a in k])
            body = np.exp(-z) * w[None, :] / 2 / k[:, None]
            return 1 - body.sum(axis=1) * np.exp(k * np.log(np.maximum(x / scale, 1e-300)) - norm)

        ok = np.isfinite(x) & np.isfinite(p) & np.isfinite(k) & (x > 0) & (k > 0) & (p >= 0.05) & (p <= 0.95)
        x, p, k = np.where(ok, x, 1.0), np.where(ok, p, 0.5), np.where(ok, k, 1.0)
        lo, hi = np.full(len(x), 1e-6) * x, 100 * x
        for _ in range(80):
            mid = (lo + hi) / 2
            over = upper(mid) > p
            lo, hi = np.where(over, lo, mid), np.where(over, mid, hi)
        return pd.Series(np.where(ok, (lo + hi) / 2 * k, np.nan)).astype("Float64").where(ok)

    return lines.withColumn(name, solve(line, p_over, shape))


def unambiguous(entries: DataFrame, entity: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Entries whose id goes by one name, and the ids that several names claim."""
    names = entries.groupBy(entity).agg(F.countDistinct(name).alias("names"))
    return entries.join(names.where("names = 1").select(entity), entity, "left_semi"), names.where("names > 1")


def week_table(quotes: DataFrame, ts: str, kickoff: str, keys: list[str]) -> DataFrame:
    """Quotes before kickoff whose key occurs once."""
    early = quotes.where(F.col(ts) < F.col(kickoff))
    return early.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("__n = 1").drop("__n")


def book_grades(lines: DataFrame, outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Settled quotes by market and book: error of the line, Brier and log loss of P(over); unsettled ones are counted."""
    j = spread(lines, *by).join(outcomes, by, "left")
    hit = F.when(F.col("actual") != F.col("point"), (F.col("actual") > F.col("point")).cast("double"))
    p = F.least(F.greatest("p_over", F.lit(1e-6)), F.lit(1 - 1e-6))
    return j.groupBy("market", "book").agg(F.count("actual").alias("settled"), F.count_if(F.col("actual").isNull()).alias("void"), F.avg(F.abs(F.col("actual") - F.col("point"))).alias("mae"), F.avg(F.col("point") - F.col("actual")).alias("bias"), F.avg((p - hit) * (p - hit)).alias("brier"), F.avg(-(hit * F.log(p) + (1 - hit) * F.log(1 - p))).alias("log_loss"))


def due(games: DataFrame, kickoff: str, now: Column, hours: float, held: DataFrame, key: str) -> DataFrame:
    """Games that start within ``hours`` and have no snapshot yet."""
    ahead = (F.unix_micros(F.col(kickoff)) - F.unix_micros(now)) / 3.6e9
    return games.where((ahead > 0) & (ahead <= hours)).join(held.select(key).distinct(), key, "left_anti")


def by_prefix(codes: DataFrame, code: str, teams: DataFrame, prefix: str) -> DataFrame:
    """The one team whose prefix starts the code; null for none or several. Prefixes of each length are equi-joined."""
    widths = [r[0] for r in teams.select(F.length(prefix)).distinct().collect()]  # lengths of a prefix
    tried = codes.select(code, F.explode(F.array(*[F.substring(F.col(code), 1, n) for n in sorted(widths)])).alias(prefix)).distinct()
    found = tried.join(teams, prefix).groupBy(code).agg(F.count(F.lit(1)).alias("__n"), F.min(prefix).alias("team"))
    return codes.join(found.where("__n = 1").drop("__n"), code, "left")
