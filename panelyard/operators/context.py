"""Schedule, weather, roster and availability context."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.scalars import implied_totals
from panelyard.operators.panels import latest_by_key
from panelyard.operators.scored import defense_score


def schedule_context(games: DataFrame, venues: DataFrame) -> DataFrame:
    """A row for each team and week: opponent, home, expected margin and points, roof, and the total against last season's mean."""
    home, away = implied_totals(F.col("total_line"), F.col("spread_line"))
    side = lambda t, o, h, i, s: F.struct(F.col(t).alias("team"), F.col(o).alias("opponent"), F.lit(h).alias("is_home"), i.alias("implied"), s.alias("spread"))
    rows = games.select("season", "week", "game_id", "stadium_id", "total_line", F.inline(F.array(side("home_team", "away_team", 1, home, F.col("spread_line")), side("away_team", "home_team", 0, away, -F.col("spread_line")))))
    last = games.groupBy((F.col("season") + 1).alias("season")).agg(F.avg("total_line").alias("__mean"))
    return rows.join(venues.select("stadium_id", "roof", "tz"), "stadium_id", "left").join(last, "season", "left").withColumn("total_over_last", F.col("total_line") - F.col("__mean")).drop("__mean")


def weather(games: DataFrame, hourly: DataFrame, hours: int = 3) -> DataFrame:
    """Mean wind and rain over the hours from kickoff, null if any hour is missing; roofed games have none, and the source is named."""
    want = games.select("game_id", "stadium_id", "roof", F.explode(F.transform(F.sequence(F.lit(0), F.lit(hours - 1)), lambda k: F.date_trunc("hour", F.timestamp_seconds(F.unix_timestamp("kickoff") + k * 3600)))).alias("time"))
    got = want.join(hourly, ["stadium_id", "time"], "left").groupBy("game_id").agg(F.max("roof").alias("roof"), F.count("wind").alias("n"), F.avg("wind").alias("w"), F.sum("rain").alias("r"))
    closed, whole = F.col("roof").isin("dome", "closed"), F.col("n") == hours
    return got.select("game_id", F.when(closed, 0.0).when(whole, F.greatest(F.col("w") - 10, F.lit(0.0))).alias("wind10"), F.when(closed, 0.0).when(whole, F.least("r", F.lit(10.0))).alias("rain"), F.when(closed, "roof").when(whole, "observed").otherwise("unknown").alias("weather_source"))


def defense_history(team_weeks: DataFrame, games: DataFrame) -> DataFrame:
    """Each team-week's defensive score from its counted events and the points of the schedule; null where those are unknown."""
    side = lambda t, a: F.struct(F.col(t).alias("team"), F.col(a).alias("allowed"))
    allowed = games.select("season", "week", F.inline(F.array(side("home_team", "away_score"), side("away_team", "home_score"))))
    return team_weeks.join(allowed, ["season", "week", "team"], "left").withColumn("points", defense_score(team_weeks.columns, F.col("allowed")))


def window_opponents(schedule: DataFrame, measure: DataFrame, windows: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Mean opponent measure over named spans of weeks; null unless every opponent's is known."""
    j = schedule.join(measure.select(F.col("team").alias("opponent"), "value"), "opponent", "left")
    cols = []
    for name, (lo, hi) in windows.items():
        inside = F.col("week").between(lo, hi)
        cols.append(F.when((F.count_if(inside) > 0) & (F.count_if(inside) == F.count_if(inside & F.col("value").isNotNull())), F.sum(F.when(inside, F.col("value"))) / F.count_if(inside)).alias(name))
    return j.groupBy("team").agg(*cols)


def roster_changes(before: DataFrame, after: DataFrame, charts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arrivals and departures by id, and each team's chart starters (ties kept)."""
    key = ["team", "player_id"]
    moves = before.select(*key).distinct().join(after.select(*key).distinct(), key, "left_anti").withColumn("move", F.lit("left")).unionByName(after.select(*key).distinct().join(before.select(*key).distinct(), key, "left_anti").withColumn("move", F.lit("arrived")))
    starters = charts.withColumn("__k", F.rank().over(Window.partitionBy("team", "position").orderBy("depth"))).where("__k = 1").drop("__k")
    return moves, starters


def dated_import(rows: DataFrame, as_of: Column, key: str, at: str) -> tuple[DataFrame, DataFrame]:
    """Rows dated up to ``as_of`` with a key of their own, and the rest with the reason."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    why = F.when(F.col(key).isNull(), "no id").when(F.col(at).isNull(), "no date").when(F.col(at) > as_of, "dated in the future").when(n > 1, "id repeats")
    judged = rows.withColumn("reason", why)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def availability_note(players: DataFrame, reports: DataFrame, tags: DataFrame, now: Column, stale_hours: float = 72) -> DataFrame:
    """Designation, practice and body part, each from the dated source that takes precedence and is not stale."""
    r = latest_by_key(reports, ["player_id"], [F.desc("at")]).select("player_id", F.col("at").alias("report_at"), "report_status", "practice_status", "injury")
    t = latest_by_key(tags, ["player_id"], [F.desc("at")]).select("player_id", F.col("at").alias("tag_at"), "tag")
    fresh = lambda c: (F.unix_micros(now) - F.unix_micros(F.col(c))) / 3.6e9 <= stale_hours
    j = players.join(r, "player_id", "left").join(t, "player_id", "left")
    use = F.coalesce(fresh("report_at"), F.lit(False)) & F.col("report_status").isNotNull()
    return j.withColumn("designation", F.when(use, F.col("report_status")).when(fresh("tag_at"), F.col("tag"))).withColumn("designation_at", F.when(use, F.col("report_at")).when(fresh("tag_at"), F.col("tag_at")))


def declared_out(reports: DataFrame, tags: DataFrame, key: Sequence[str]) -> DataFrame:
    """Out by the report or by the platform's tag; the report is named where both say so."""
    a = reports.where("report_status = 'Out'").select(*key, F.lit(1).alias("k"))
    b = tags.where(F.col("tag").isin("Out", "IR", "PUP", "Sus")).select(*key, F.lit(2).alias("k"))
    return a.unionByName(b).groupBy(*key).agg(F.when(F.min("k") == 1, "report").otherwise("tag").alias("by"))


def roster_evidence(rosters: DataFrame, usage: DataFrame, games: DataFrame, notes: DataFrame) -> DataFrame:
    """Every rostered entity with its usage, game and availability; blanks stay blank."""
    return rosters.join(usage, "player_id", "left").join(games, "team", "left").join(notes.select("player_id", "designation"), "player_id", "left")


def manager_profile(picks: DataFrame, results: DataFrame) -> DataFrame:
    """Picks against the market, rounds by position, and the record of each manager."""
    reach = F.col("adp") - F.col("pick")
    p = picks.groupBy("manager").agg(F.count(F.lit(1)).alias("picks"), F.avg(reach).alias("mean_reach"), F.max_by("player_id", reach).alias("biggest_reach"), *[F.min(F.when(F.col("position") == c, F.col("round"))).alias(f"first_{c}") for c in ("QB", "RB", "WR", "TE")])
    r = results.groupBy("manager").agg(F.count(F.lit(1)).alias("seasons"), F.sum("wins").alias("wins"), F.sum("losses").alias("losses"), F.sum("pf").alias("pf"))
    return p.join(r, "manager", "full").withColumn("win_share", F.when(F.col("wins") + F.col("losses") > 0, F.col("wins") / (F.col("wins") + F.col("losses"))))


def game_of_team(teams: DataFrame, games: DataFrame, proofs: DataFrame, covered: Column) -> DataFrame:
    """What a team has in a week: a game, a proven bye, no row, or no schedule."""
    j = teams.join(games.withColumn("__g", F.lit(True)), ["team", "week"], "left").join(proofs.select("team", "off_periods"), "team", "left")
    state = F.when(F.col("__g"), "game").when(~covered, "no schedule").when(F.coalesce(F.array_contains("off_periods", F.col("week")), F.lit(False)), "bye").otherwise("no row")
    return j.withColumn("state", state).drop("__g", "off_periods")


def waiver_runs(days: DataFrame, weekday: int, clock: str, zone: str) -> DataFrame:
    """Instants of a weekly run: the dates of a weekday (1 is Sunday) at a local time."""
    return days.where(F.dayofweek("day") == weekday).select(F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", F.col("day").cast("string"), F.lit(clock))), zone).alias("run_at"))


def around(rows: DataFrame, runs: DataFrame, at: str) -> DataFrame:
    """The last run at or before each instant and the next one after: both marked on one sorted line of a week's span.

    Runs are weekly, so each instant is compared only with those of its own week and the ones beside it.
    """
    week = lambda c: F.floor(F.unix_seconds(c) / 604800)
    near = runs.select("run_at", F.explode(F.array(week(F.col("run_at")) - 1, week(F.col("run_at")), week(F.col("run_at")) + 1)).alias("__w"))
    spans = near.groupBy("__w").agg(F.array_sort(F.collect_set("run_at")).alias("__runs"))  # at most three weeks' runs
    j = rows.withColumn("__w", week(F.col(at))).join(spans, "__w", "left")
    return j.withColumn("last_run", F.array_max(F.filter("__runs", lambda r: r <= F.col(at)))).withColumn("next_run", F.array_min(F.filter("__runs", lambda r: r > F.col(at)))).drop("__w", "__runs")


def candidates(names: DataFrame, rosters: DataFrame, parts: int = 16) -> DataFrame:
    """Roster rows consistent with every market of an unresolved name: same team, and a position that each market allows.

    Names are judged against the kinds of player a team has (sets of positions),
    so that only rows of the answer are made from names and players. These meet
    in ``parts`` shares of the players, as teams may be few.
    """
    n = names.groupBy("name", "team").agg(F.countDistinct("market").alias("markets"))
    players = rosters.groupBy("team", "player_id").agg(F.array_sort(F.collect_set("position")).alias("positions"))
    fits = names.join(players.select("team", "positions").distinct(), "team").where(F.arrays_overlap("allowed_positions", "positions")).groupBy("name", "team", "positions").agg(F.countDistinct("market").alias("fit"))
    fits = fits.join(n, ["name", "team"]).where("fit = markets").select("name", "team", "positions", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    dealt = players.withColumn("part", F.pmod(F.xxhash64("player_id"), F.lit(parts)).cast("int"))
    return fits.join(dealt, ["team", "positions", "part"]).select("name", "team", "player_id")
