"""Scalar functions: every one takes and returns Columns, so it stays in generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and the plain ones they fold to, and name suffixes that are dropped.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
FOLD_TO = "aaaaaaceeeeiiiinoooooouuuuyy"
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")


def normalize_id(c: Column) -> Column:
    """A trimmed id without a float's ``.0``; blank, ``nan`` and ``none`` become ''."""
    s = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return F.when(s.isNull() | F.lower(s).isin("", "nan", "none", "na", "<na>"), "").otherwise(s)


def name_key(c: Column) -> Column:
    """Lower-case ASCII letters of a name, accents folded and a generation suffix dropped."""
    folded = F.translate(F.lower(c), FOLD_FROM, FOLD_TO)
    bare = F.regexp_replace(folded, r"\s+(" + "|".join(SUFFIXES) + r")\.?\s*$", "")
    return F.regexp_replace(bare, "[^a-z]", "")


def count_in_text(c: Column, unit: str) -> Column:
    """The number before ``unit`` in a text such as ``"1 RB, 2 TE"``; 0 where it is not named, null for null."""
    found = F.regexp_extract(c, rf"(\d+) {unit}", 1)
    return F.when(c.isNull(), None).when(found == "", 0).otherwise(found.cast("int"))


def split_list(c: Column, sep: str = ";") -> Column:
    """Trimmed, non-empty members of a separated list."""
    return F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")


def parse_tokens(c: Column) -> Column:
    """``"7:KC:12.3 8:SF:4"`` as an array of (period, opponent, points)."""
    return F.transform(F.filter(F.split(c, r"\s+"), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[0].cast("int").alias("period"), F.split(x, ":")[1].alias("opponent"), F.split(x, ":")[2].cast("double").alias("points")))


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den``, null where the denominator is not positive."""
    return F.when(den > 0, num.cast("double") / den)


def implied_probability(price: Column) -> Column:
    """The probability an American price states, margin included; null strictly between -100 and 100."""
    p = price.cast("double")
    return F.when(p >= 100, 100.0 / (p + 100.0)).when(p <= -100, -p / (-p + 100.0))


def implied_totals(total: Column, spread: Column) -> tuple[Column, Column]:
    """Home and away expected points from a total and the home side's expected margin."""
    return (total + spread) / 2.0, (total - spread) / 2.0


def linear(c: Column, intercept: float, slope: float) -> Column:
    return F.lit(intercept) + F.lit(slope) * c


def line_multiplier(implied: Column, intercept: float, slope: float, mean: float) -> Column:
    """A linear effect relative to its value at the mean line."""
    return linear(implied, intercept, slope) / (intercept + slope * mean)


def points_per_chance(weights: Mapping[str, float], rates: Mapping[str, float]) -> float:
    """Expected score of one chance from outcome rates and their weights."""
    return sum(weights[k] * v for k, v in rates.items())


def shrink_weight(n: Column, n0: Column | float) -> Column:
    """The share of trust in ``n`` observations against a prior worth ``n0``."""
    return n.cast("double") / (n + n0)


def eb_shrink(x: Column, n: Column, prior: Column | float, n0: Column | float) -> Column:
    """Sum ``x`` over ``n`` chances drawn to ``prior``: (x + prior n0) / (n + n0)."""
    return (x + prior * n0) / (n + n0)


def over_league(x: Column, n: Column, mean: Column, n0: float) -> Column:
    """Rate above the league's, shrunk: (x - n m) / (n + n0)."""
    return (x - n * mean) / (n + n0)


def reliability_n0(n: float, reliability: float) -> float:
    """The prior size at which ``n`` observations have this reliability."""
    return n * (1 - reliability) / reliability


def beta_moments(mean: Column, var: Column) -> tuple[Column, Column]:
    """Beta parameters with this mean and variance; null where there are none."""
    k = F.when((var > 0) & (var < mean * (1 - mean)), mean * (1 - mean) / var - 1)
    return mean * k, (1 - mean) * k


# Hart's rational approximation of the normal tail to double precision, lowest power first, and where its continued fraction takes over.
TAIL_NUM = (220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 0.0352624965998911)
TAIL_DEN = (440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 0.0883883476483184)
TAIL_SPLIT = 7.07106781186547


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, to 1e-14."""
    x = F.abs(z.cast("double"))
    horner = lambda cs: reduce(lambda acc, c: acc * x + c, reversed(cs[:-1]), F.lit(cs[-1]))
    far = x + 1.0 / (x + 2.0 / (x + 3.0 / (x + 4.0 / (x + 0.65))))
    tail = F.exp(-x * x / 2.0) * F.when(x < TAIL_SPLIT, horner(TAIL_NUM) / horner(TAIL_DEN)).otherwise(1.0 / (far * 2.506628274631))
    return F.when(z > 0, 1.0 - tail).otherwise(tail)


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2.0) * 0.3989422804014327


def margin_sd(sa: Column, sb: Column, rho: float = 0.0) -> Column:
    return F.sqrt(F.greatest(sa * sa + sb * sb - 2.0 * rho * sa * sb, F.lit(0.0)))


def win_probability(ma: Column, sa: Column, mb: Column, sb: Column, rho: float = 0.0, k: float = 1.0) -> Column:
    """P(A beats B) under a normal margin; where nothing spreads, 1, 0 or a half."""
    s, d = margin_sd(k * sa, k * sb, rho), ma - mb
    return F.when(s > 0, normal_cdf(d / s)).when(d > 0, 1.0).when(d < 0, 0.0).when(d == 0, 0.5)


def leverage(ma: Column, sa: Column, mb: Column, sb: Column, rho: float = 0.0) -> Column:
    """Win probability gained per expected point of A."""
    s = margin_sd(sa, sb, rho)
    return F.when(s > 0, normal_pdf((ma - mb) / s) / s).otherwise(0.0)


def spread_effect(ma: Column, sa: Column, mb: Column, sb: Column, rho: float = 0.0) -> Column:
    """Win probability gained per unit of A's spread: positive for the weaker side."""
    s, d = margin_sd(sa, sb, rho), ma - mb
    return F.when(s > 0, -normal_pdf(d / s) * d * (sa - rho * sb) / (s * s * s)).otherwise(0.0)


def anytime_rate(p: Column) -> Column:
    """Mean of a Poisson count that is positive with probability ``p``."""
    return F.when((p >= 0) & (p < 1), -F.log1p(-p))


def poisson_cdf(k: Column, mean: Column) -> Column:
    """P(X <= k) by the running term, in a higher-order function."""
    steps = F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1)))
    start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("total"))
    end = F.aggregate(steps, start, lambda acc, i: F.struct((acc["term"] * mean / i).alias("term"), (acc["total"] + acc["term"] * mean / i).alias("total")))
    return F.when(k < 0, 0.0).when(k < 1, F.exp(-mean)).otherwise(end["total"])


def local_to_utc(day: Column, clock: Column, zone: str = "America/New_York") -> Column:
    """The instant of a local day and clock; null where either is unknown or unreadable."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.concat(day.cast("string"), F.lit(" "), clock)), zone)


def zone_offset_hours(at: Column, zone: str) -> Column:
    """Hours between a zone's clock and UTC at an instant."""
    return (F.unix_timestamp(F.from_utc_timestamp(at, zone)) - F.unix_timestamp(at)) / 3600.0


def season_of(day: Column) -> Column:
    """January and February belong to the season before."""
    return F.year(day) - (F.month(day) < 3).cast("int")


def age_hours(then: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(then)) / 3.6e9


def age_limit(now: Column, usual: Column, game_day: Column, days: Sequence[int] = (1, 2, 5)) -> Column:
    """The age limit in force: shorter on game days (1 is Sunday)."""
    return F.when(F.dayofweek(F.from_utc_timestamp(now, "America/New_York")).isin(*days), game_day).otherwise(usual)


def clock_elapsed(quarter: Column, left: Column) -> Column:
    """Seconds played; a fifth quarter is ten minutes after the hour."""
    return F.when(quarter >= 5, 3600 + F.greatest(600 - left, F.lit(0))).otherwise(F.greatest(3600 - left, F.lit(0)))


def age_years(born: Column, at: Column) -> Column:
    return F.datediff(at, born) / 365.25


def distance_bucket(d: Column, width: int = 5, most: int = 60) -> Column:
    return (F.floor(F.least(d, F.lit(most)) / width) * width).cast("int")


def snake_pick(slot: Column, round_no: Column, teams: int) -> Column:
    """Overall pick number: odd rounds in order, even rounds reversed."""
    return (round_no - 1) * teams + F.when(round_no % 2 == 1, slot).otherwise(teams + 1 - slot)


def availability(pick: Column, adp: Column) -> Column:
    """P(still there at a pick): the market's mean place with a spread that grows with it."""
    sd = F.greatest(F.lit(1.0), 0.57 + 0.11 * adp)
    return 1.0 - normal_cdf((pick - 0.5 - adp) / sd)


def survival(pick: Column, now: Column, adp: Column) -> Column:
    """P(there at ``pick`` | there ``now``)."""
    base = availability(now, adp)
    return F.when(base > 0, F.least(availability(pick, adp) / base, F.lit(1.0)))


def digest(*cols: Column | str) -> Column:
    """SHA-256 of the columns as one JSON document."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The texts whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in pairs]))


def json_field(c: Column, path: str, kind: str = "double") -> Column:
    return F.get_json_object(c, path).cast(kind)


def coalesce_flag(c: Column) -> Column:
    """A 0/1 flag whose missing value is false."""
    return F.coalesce(c.cast("int"), F.lit(0)) == 1
