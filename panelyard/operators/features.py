"""Features as of each period, built from earlier periods only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators.panels import as_of_sums, asof_join, league_to_date


def core(facts: DataFrame, entity: str, season: str, on: str, cols: Sequence[str], last: int = 3) -> DataFrame:
    """Season and last-``last`` means before each row, for all periods in one windowed pass."""
    w = Window.partitionBy(entity, season).orderBy(on)
    past, recent = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(-last, -1)
    return facts.withColumns({"games": F.count(F.lit(1)).over(past), **{f"{c}_mean": F.sum(c).over(past) / F.count(c).over(past) for c in cols}, **{f"{c}_recent": F.sum(c).over(recent) / F.count(c).over(recent) for c in cols}})


def share_history(facts: DataFrame, entity: str, group: str, season: str, on: str, col: str, last: int = 3) -> DataFrame:
    """An entity's share of its group's total over the games it played, to date and recent; null where the group has none."""
    rows = facts.withColumn("__team", F.sum(col).over(Window.partitionBy(group, season, on)))
    got = as_of_sums(rows, [entity, season], on, [col, "__team"], last)
    ratio = lambda s: F.when(F.col(f"__team_{s}") > 0, F.col(f"{col}_{s}") / F.col(f"__team_{s}"))
    return got.withColumn("share_std", ratio("std")).withColumn(f"share_l{last}", ratio(f"l{last}")).drop("__team", "__team_std", f"__team_l{last}")


def vacated(rows: DataFrame, by: Sequence[str], share: str, away: Column, role: str | None = None) -> DataFrame:
    """Work of those away, and each active member's part of it.

    ``pickup`` is V x own / S: V the shares away, S those active (of the same
    role where one is given); 0 where nothing is away or the member is away
    itself, null where nobody is active.
    """
    w = Window.partitionBy(*by, *([role] if role else []))
    v = F.coalesce(F.sum(F.when(away, F.col(share))).over(w), F.lit(0))
    s = F.coalesce(F.sum(F.when(~away, F.col(share))).over(w), F.lit(0))
    return rows.withColumn("vacated", v).withColumn("pickup", F.when((v == 0) | away, 0.0).when(s > 0, v * F.col(share) / s))


def role_change(facts: DataFrame, entity: str, group: str, on: str, col: str, n: int = 3) -> DataFrame:
    """Last value, its jump over the ``n`` before, and the share of the group's last period."""
    w = Window.partitionBy(entity).orderBy(on)
    before = w.rowsBetween(-n - 1, -2)
    rows = facts.withColumn("__share", F.col(col) / F.sum(col).over(Window.partitionBy(group, on)))
    return rows.withColumn("last", F.lag(col).over(w)).withColumn("jump", F.lag(col).over(w) - F.sum(col).over(before) / F.count(col).over(before)).withColumn("last_share", F.lag("__share").over(w)).drop("__share")


def opponent_relative(facts: DataFrame, opponent: str, season: str, on: str, num: str, den: str) -> DataFrame:
    """What an opponent has allowed to date as a ratio, less the league's to date."""
    per = facts.groupBy(opponent, season, on).agg(F.sum(num).alias(num), F.sum(den).alias(den))
    own = as_of_sums(per, [opponent, season], on, [num, den])
    league = league_to_date(facts, on, [num, den], [season])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return own.join(league, [season, on]).withColumn("relative", ratio(f"{num}_std", f"{den}_std") - ratio(f"{num}_lg", f"{den}_lg"))


def tendency(obs: DataFrame, person: str, group: str, season: str, on: str, value: str, bucket: str, k: float) -> DataFrame:
    """A person's pooled deviation from the league's mean of each bucket: earlier seasons and this one to date.

    (career deviation + season deviation) / (career n + season n + k); null
    where there is no observation. The career follows the person across groups.
    """
    league = obs.groupBy(season, bucket).agg((F.sum(value) / F.count(value)).alias("__m"))
    dev = obs.join(league, [season, bucket]).withColumn("__d", F.col(value) - F.col("__m"))
    per = dev.groupBy(person, group, season, on).agg(F.sum("__d").alias("__d"), F.count("__d").alias("__n"))
    now = Window.partitionBy(person, group, season).orderBy(on).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("season_dev", F.sum("__d").over(now)).withColumn("season_n", F.sum("__n").over(now))
    year = per.groupBy(person, season).agg(F.sum("__d").alias("__d"), F.sum("__n").alias("__n"))
    past = Window.partitionBy(person).orderBy(season).rowsBetween(Window.unboundedPreceding, -1)
    career = year.select(person, season, F.sum("__d").over(past).alias("career_dev"), F.sum("__n").over(past).alias("career_n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    n = zero("career_n") + zero("season_n")
    return per.join(career, [person, season]).withColumn("pooled", F.when(n > 0, (zero("career_dev") + zero("season_dev")) / (n + k))).drop("__d", "__n")


def conditional_shares(events: DataFrame, entity: str, group: str, by: Sequence[str], predicates: dict[str, Column]) -> DataFrame:
    """Counts of events under each predicate, own and the group's, in one aggregation, and their shares."""
    own = events.groupBy(entity, group, *by).agg(*[F.count_if(p).alias(k) for k, p in predicates.items()])
    w = Window.partitionBy(group, *by)
    return own.withColumns({f"{k}_share": F.when(F.sum(k).over(w) > 0, F.col(k) / F.sum(k).over(w)) for k in predicates})


def newcomers(facts: DataFrame, entity: str, group: str, on: str) -> DataFrame:
    """Whether a member was not in the group's previous period (null in its first), and earlier periods with the group."""
    calendar = facts.select(group, on).distinct().withColumn("__g", F.row_number().over(Window.partitionBy(group).orderBy(on)))
    rows = facts.join(calendar, [group, on])
    w = Window.partitionBy(entity, group).orderBy("__g")
    before = F.coalesce(F.lag("__g").over(w) == F.col("__g") - 1, F.lit(False))
    return rows.withColumn("newcomer", F.when(F.col("__g") > 1, ~before)).withColumn("tenure", F.row_number().over(w) - 1).drop("__g")


def absence_ramp(facts: DataFrame, entity: str, group: str, on: str) -> DataFrame:
    """Group periods missed since the entity's last one, and how many it has played since a break of two or more."""
    calendar = facts.select(group, on).distinct().withColumn("__g", F.row_number().over(Window.partitionBy(group).orderBy(on)))
    w = Window.partitionBy(entity, group).orderBy("__g")
    rows = facts.join(calendar, [group, on]).withColumn("missed", F.col("__g") - F.lag("__g").over(w) - 1)
    rows = rows.withColumn("__run", F.sum((F.coalesce("missed", F.lit(0)) >= 2).cast("int")).over(w))
    back = F.row_number().over(Window.partitionBy(entity, group, "__run").orderBy("__g"))
    return rows.withColumn("since_return", F.when(F.col("__run") > 0, back)).drop("__g", "__run")


def calendar_effects(games: DataFrame, team: str, kickoff: str, zone_hours: str, home_zone_hours: str) -> DataFrame:
    """Days of rest (clipped to 4-14), short week, and zones crossed (at most 3)."""
    days = F.datediff(F.col(kickoff), F.lag(kickoff).over(Window.partitionBy(team).orderBy(kickoff)))
    return games.withColumn("rest", F.least(F.greatest(days, F.lit(4)), F.lit(14))).withColumn("short_week", (days <= 5).cast("int")).withColumn("zones", F.least(F.abs(F.col(zone_hours) - F.col(home_zone_hours)), F.lit(3.0)))


def bucket_expectation(tries: DataFrame, season: str, bucket: str, made: str, seasons: int = 3) -> DataFrame:
    """Each bucket's share made over the ``seasons`` before: a season's rows stand for those that follow it."""
    per = tries.groupBy(season, bucket).agg(F.sum(made).alias("__m"), F.count(made).alias("__n"))
    later = per.select(bucket, "__m", "__n", F.explode(F.transform(F.sequence(F.lit(1), F.lit(seasons)), lambda k: F.col(season) + k)).alias(season))
    return later.groupBy(season, bucket).agg((F.sum("__m") / F.sum("__n")).alias("expected"))


def known_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Where a column has any null: 0 in its place and a flag ``<col>__known`` beside it. One pass finds which."""
    holes = df.agg(*[F.max(F.col(c).isNull().cast("int")).alias(c) for c in cols]).first()
    gaps = [c for c in cols if holes[c] == 1]
    return df.withColumns({**{f"{c}__known": F.col(c).isNotNull().cast("int") for c in gaps}, **{c: F.coalesce(c, F.lit(0)) for c in gaps}})


def leak_rows(build, facts: DataFrame, on: str, through: int, keys: Sequence[str]) -> DataFrame:
    """Rows up to a period that change when everything after it is taken away: none, for an honest builder."""
    full, cut = build(facts).where(F.col(on) <= through), build(facts.where(F.col(on) <= through))
    return full.exceptAll(cut.select(*full.columns)).unionByName(cut.select(*full.columns).exceptAll(full)).select(*keys).distinct()


def expected_starter(charts: DataFrame, out: DataFrame, by: Sequence[str], entity: str, rank: str) -> DataFrame:
    """The first on the chart who is not out, one a group; ties to the smaller id."""
    here = charts.join(out.select(*by, entity).distinct(), [*by, entity], "left_anti")
    return here.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(rank, entity))).where("__k = 1").drop("__k")


def latest_status(players: DataFrame, statuses: DataFrame, by: Sequence[str], on: str, value: str) -> DataFrame:
    """The latest status at or before each row's period."""
    return asof_join(players, statuses, by, on, [value], strict=False)
