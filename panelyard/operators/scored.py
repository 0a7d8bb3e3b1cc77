"""Scored tables: rules turned into columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The usual weights and tiers, as rules that callers can replace.
OFFENSE = {
    "pass_yd": (0.04, ["passing_yards"], []),
    "pass_td": (4.0, ["passing_tds"], []),
    "interception": (-1.0, ["passing_interceptions"], ["interceptions"]),
    "rush_yd": (0.1, ["rushing_yards"], []),
    "rush_td": (6.0, ["rushing_tds"], []),
    "reception": (0.5, ["receptions"], []),
    "rec_yd": (0.1, ["receiving_yards"], []),
    "rec_td": (6.0, ["receiving_tds"], []),
    "fumble_lost": (-2.0, ["sack_fumbles_lost", "rushing_fumbles_lost", "receiving_fumbles_lost"], ["fumbles_lost"]),
    "two_pt": (2.0, ["passing_2pt_conversions", "rushing_2pt_conversions", "receiving_2pt_conversions"], ["two_point_conversions"]),
}
KICKING = {
    "fg_short": (3.0, ["fg_made_0_19", "fg_made_20_29", "fg_made_30_39"], []),
    "fg_40": (4.0, ["fg_made_40_49"], []),
    "fg_50": (5.0, ["fg_made_50_59", "fg_made_60_"], []),
    "pat": (1.0, ["pat_made"], []),
    "fg_miss": (-1.0, ["fg_missed"], []),
    "pat_miss": (-1.0, ["pat_missed"], []),
}
DEFENSE = {
    "td": (6.0, ["def_tds"], []),
    "sack": (1.0, ["sacks"], []),
    "interception": (2.0, ["interceptions"], []),
    "fumble": (2.0, ["fumbles_recovered"], []),
    "safety": (2.0, ["safeties"], []),
    "forced": (1.0, ["fumbles_forced"], []),
    "block": (2.0, ["blocks"], []),
}
ALLOWED_TIERS = [(0, 10.0), (6, 7.0), (13, 4.0), (20, 1.0), (27, 0.0), (34, -1.0)]
ALLOWED_REST = -4.0

Rules = Mapping[str, tuple[float, Sequence[str], Sequence[str]]]


def number(c: Column) -> Column:
    """A missing or NaN cell scores as 0."""
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def weighted_score(columns: Sequence[str], rules: Rules) -> Column:
    """Sum of weight x components; a rule's old columns are read only where the schema has none of the new."""
    terms = []
    for weight, parts, legacy in rules.values():
        there = [c for c in parts if c in columns] or [c for c in legacy if c in columns]
        if there:
            terms.append(F.lit(weight) * reduce(lambda a, b: a + b, [number(F.col(c)) for c in there]))
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def tier(value: Column, tiers: Sequence[tuple[float, float]], rest: float) -> Column:
    """The value's step: the first limit that it does not exceed; null for null."""
    out = F.when(value.isNull(), None)
    for most, points in tiers:
        out = out.when(value <= most, points)
    return out.otherwise(rest)


def defense_score(columns: Sequence[str], allowed: Column, rules: Rules = DEFENSE) -> Column:
    """Counted events plus the tier of points allowed; null where those are unknown."""
    return weighted_score(columns, rules) + tier(allowed, ALLOWED_TIERS, ALLOWED_REST)


def routed_score(columns: Sequence[str], position: str = "position") -> Column:
    """Kickers by kicking rules, all others by offense rules."""
    return F.when(F.col(position) == "K", weighted_score(columns, KICKING)).otherwise(weighted_score(columns, OFFENSE))


def player_weeks(weekly: DataFrame, snaps: DataFrame) -> DataFrame:
    """One scored row for each player and week with snaps beside it; opportunities are null only where both parts are."""
    parts = [F.col(c) for c in ("targets", "carries")]
    opps = F.when(parts[0].isNull() & parts[1].isNull(), None).otherwise(F.coalesce(parts[0], F.lit(0.0)) + F.coalesce(parts[1], F.lit(0.0)))
    one = snaps.groupBy("player_id", "season", "week").agg(F.max("offense_snaps").alias("offense_snaps"), F.max("offense_pct").alias("offense_pct"))
    return weekly.withColumn("points", routed_score(weekly.columns)).withColumn("opportunities", opps).join(one, ["player_id", "season", "week"], "left")


def credits(plays: DataFrame) -> DataFrame:
    """Each play's points to those who made them: passer, rusher, receiver, one row each, zeros left out."""
    n = lambda c: number(F.col(c))
    who = F.array(
        F.struct(F.col("passer_id").alias("entity"), (0.04 * n("passing_yards") + 4 * n("pass_touchdown") - n("interception")).alias("points")),
        F.struct(F.col("rusher_id").alias("entity"), (0.1 * n("rushing_yards") + 6 * n("rush_touchdown")).alias("points")),
        F.struct(F.col("receiver_id").alias("entity"), (0.5 * n("complete_pass") + 0.1 * n("receiving_yards") + 6 * n("pass_touchdown")).alias("points")),
    )
    return plays.select("game_id", "play_id", F.inline(F.filter(who, lambda x: x["entity"].isNotNull() & (x["points"] != 0))))


def practice_flags(reports: DataFrame) -> DataFrame:
    """Final weekly report as 0/1 flags."""
    s, p = F.lower(F.coalesce("report_status", F.lit(""))), F.lower(F.coalesce("practice_status", F.lit("")))
    return reports.withColumns({"is_out": (s == "out").cast("int"), "is_doubtful": (s == "doubtful").cast("int"), "is_questionable": (s == "questionable").cast("int"), "did_not_practice": p.startswith("did not").cast("int"), "limited": p.startswith("limited").cast("int")})


SEVERITY = {"Out": 3, "Doubtful": 2, "Questionable": 1}


def most_severe(reports: DataFrame, by: Sequence[str], status: str = "report_status", order: Mapping[str, int] = SEVERITY) -> DataFrame:
    """The most severe status of each key, ties to the later name."""
    rank = F.coalesce(*[F.when(F.col(status) == k, F.lit(v)) for k, v in order.items()], F.lit(0))
    return reports.groupBy(*by).agg(F.max_by(status, F.struct(rank, F.col(status))).alias(status), F.max(rank).alias("severity"))


def availability(players: DataFrame, rosters: DataFrame, reports: DataFrame) -> DataFrame:
    """``out`` or ``questionable`` for each player-week, or null.

    Out: reported out, or the team has a roster that week and the player is not on it.
    """
    key = ["season", "week", "player_id"]
    have = rosters.select("season", "week", "team").distinct().withColumn("__has", F.lit(True))
    on = rosters.select(*key).distinct().withColumn("__on", F.lit(True))
    worst = most_severe(reports, key)
    got = players.join(have, ["season", "week", "team"], "left").join(on, key, "left").join(worst, key, "left")
    state = F.when((F.col("report_status") == "Out") | (F.col("__has") & F.col("__on").isNull()), "out").when(F.col("report_status").isin("Doubtful", "Questionable"), "questionable")
    return got.withColumn("availability", state).drop("__has", "__on", "severity")


def snap_only_zeros(box: DataFrame, played: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Outcomes of all who played: the box score's value, or 0 for those with no line."""
    lost = played.select(*keys).distinct().join(box, list(keys), "left_anti").withColumn(value, F.lit(0.0))
    return box.select(*keys, value).unionByName(lost)


def charted(own: DataFrame, charts: DataFrame, game: Sequence[str], value: str) -> DataFrame:
    """A count that is 0 only where the game was charted, else null."""
    seen = charts.select(*game).distinct().withColumn("__seen", F.lit(1))
    return own.join(seen, list(game), "left").withColumn(value, F.when(F.col("__seen") == 1, F.coalesce(value, F.lit(0)))).drop("__seen")


def draft_ledger(picks: DataFrame, value: str = "value") -> DataFrame:
    """Every pick beside the best player of its draft still there: the greatest value among those taken later.

    ``picks`` has ``draft``, ``pick`` and the value; players never taken have a null pick.
    Picks are read from the last to the first: a frame that grows costs a step a
    row, one that shrinks is summed up anew for every row of the draft.
    """
    later = Window.partitionBy("draft").orderBy(F.col("pick").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return picks.withColumn("best_left", F.max(value).over(later)).where("pick IS NOT NULL").withColumn("given_up", F.greatest(F.col("best_left") - F.col(value), F.lit(0)))
