"""Play-level predicates, histories and tendencies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.scalars import coalesce_flag
from panelyard.operators.panels import as_of_sums, asof_join, league_to_date, spread

flag = coalesce_flag


def f(name: str) -> Column:
    return flag(F.col(name))


def is_target() -> Column:
    """A pass thrown at a named receiver."""
    return f("pass_attempt") & ~f("sack") & F.col("receiver_id").isNotNull()


def is_designed_run() -> Column:
    return f("rush_attempt") & ~f("qb_scramble")


def is_scramble() -> Column:
    return f("qb_scramble")


def is_scrimmage() -> Column:
    return (f("pass_attempt") | f("rush_attempt") | f("qb_dropback")) & ~f("two_point_attempt")


def is_neutral() -> Column:
    """Win probability 0.2-0.8, first three quarters, more than two minutes left in the half."""
    return is_scrimmage() & F.col("wp").between(0.2, 0.8) & (F.col("qtr") <= 3) & (F.col("half_seconds_remaining") > 120)


def is_aimed_pass() -> Column:
    return f("pass_attempt") & ~f("sack") & ~f("qb_spike") & ~f("two_point_attempt") & F.col("air_yards").isNotNull()


def is_deep(yards: int = 20) -> Column:
    return is_aimed_pass() & (F.col("air_yards") >= yards)


# Sites of muscle strains (whole words, and one phrase), and reports that are no injury (phrases, words, whole texts).
SOFT_TISSUE = "hamstring hamstrings groin calf calves quad quads quadricep quadriceps thigh pectoral oblique abdomen abdominal adductor".split()
SOFT_PHRASES = ("hip flexor",)
NOT_INJURED = ("not injury related", "personal", "coach", "suspension", "decision", "travel", "inactive", "load management", "covid", "discipline", "illness")
NOT_INJURED_WORDS = ("rest", "resting")
NOT_INJURED_TEXTS = ("other", "nir")


def is_soft_tissue(c: Column) -> Column:
    """A report that names a muscle strain, by whole words."""
    return F.coalesce(F.lower(c).rlike(r"\b(?:" + "|".join(SOFT_TISSUE) + r")\b|" + "|".join(SOFT_PHRASES)), F.lit(False))


def is_real_injury(c: Column) -> Column:
    """A report that names an injury: not blank, and not a rest day, personal matter, decision, journey or illness."""
    text = F.lower(F.trim(c))
    other = text.isin("", *NOT_INJURED_TEXTS) | text.rlike("|".join(NOT_INJURED)) | text.rlike(r"\b(?:" + "|".join(NOT_INJURED_WORDS) + r")\b")
    return F.coalesce(~other, F.lit(False))


def on_reserve(status: Column, code: Column) -> Column:
    return F.coalesce(status.isin("RES", "PUP", "NFI", "SUS"), F.lit(False)) | F.coalesce(code.startswith("R") & ~code.isin("R/Retired"), F.lit(False))


def pool(entities: DataFrame, rosters: DataFrame, entity: str, projected: Column) -> DataFrame:
    """Active, with a team, projectable, and on no roster."""
    return entities.where((F.col("status") == "Active") & F.col("team").isNotNull() & projected).join(rosters.select(entity).distinct(), entity, "left_anti")


def above_floors(rows: DataFrame, rules: DataFrame, stat: str, category: str, gate: str) -> DataFrame:
    """Rows of a stat whose category it applies to and whose gate reaches the rule's floor; ``rules`` is one row a (stat, category)."""
    return rows.join(rules, [stat, category]).where(F.col(gate) >= F.col("floor")).drop("floor")


def mean_fill(rows: DataFrame, training: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Nulls replaced with the training mean of their group."""
    means = training.groupBy(*by).agg(*[F.avg(c).alias(f"__{c}") for c in cols])
    return rows.join(means, list(by), "left").withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__{c}")) for c in cols}).drop(*[f"__{c}" for c in cols])


def clipped(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    out = c if lo is None else F.greatest(c, F.lit(lo))
    return out if hi is None else F.least(out, F.lit(hi))


def routes(plays: DataFrame, participation: DataFrame) -> DataFrame:
    """Dropbacks on the field per player and game, and the team's share of them; of several teams the one with most."""
    drop = plays.where(f("qb_dropback")).select("game_id", "play_id", "posteam")
    on = participation.select("game_id", "play_id", F.explode(F.filter(F.transform(F.split("offense_players", ";"), lambda x: F.trim(x)), lambda x: x != "")).alias("player_id"))
    per = drop.join(on, ["game_id", "play_id"]).groupBy("game_id", "posteam", "player_id").agg(F.count(F.lit(1)).alias("routes"))
    team = drop.groupBy("game_id", "posteam").agg(F.count(F.lit(1)).alias("dropbacks"))
    share = per.join(team, ["game_id", "posteam"]).withColumn("route_share", F.col("routes") / F.col("dropbacks"))
    return share.withColumn("__k", F.row_number().over(Window.partitionBy("game_id", "player_id").orderBy(F.desc("routes"), "posteam"))).where("__k = 1").drop("__k")


def event_history(plays: DataFrame, played: DataFrame, entity: str, group: str, by: Sequence[str], events: Mapping[str, Column]) -> DataFrame:
    """Own and group counts of each event for every game an entity played, 0 where it had none: one pass over the plays."""
    own = plays.groupBy(*by, group, entity).agg(*[F.count_if(p).alias(k) for k, p in events.items()])
    team = plays.groupBy(*by, group).agg(*[F.count_if(p).alias(f"{k}_team") for k, p in events.items()])
    got = played.select(*by, group, entity).distinct().join(own, [*by, group, entity], "left").join(team, [*by, group], "left")
    return got.fillna(0, [*events, *[f"{k}_team" for k in events]])


def drives(plays: DataFrame) -> DataFrame:
    """Each drive's closest yard line and first result."""
    return plays.where("posteam IS NOT NULL").groupBy("season", "week", "game_id", "posteam", "fixed_drive").agg(F.min("yardline_100").alias("closest"), F.min_by("fixed_drive_result", "play_id").alias("result"))


def on_grid(grid: DataFrame, counts: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Counts on every row of a game grid, 0 where there were none."""
    return grid.join(counts, list(keys), "left").fillna(0, list(cols))


def tendency_observations(plays: DataFrame, person: str, min_runs: int = 10) -> DataFrame:
    """Every observation of a caller's habits as (kind, person, group, season, week, game_id, bucket, value)."""
    base = [person, F.col("posteam").alias("grp"), "season", "week", "game_id"]
    zone = F.when(F.col("yardline_100") <= 20, "red").otherwise("open")
    obs = lambda df, kind, bucket, value: df.select(F.lit(kind).alias("kind"), *base, bucket.alias("bucket"), value.cast("double").alias("value"))
    scr = plays.where(is_scrimmage())
    neutral = plays.where(is_neutral())
    w = Window.partitionBy("game_id", "posteam", "fixed_drive").orderBy("play_id")
    gap = F.lag("game_seconds_remaining").over(w) - F.col("game_seconds_remaining")
    paced = neutral.withColumn("__gap", gap).where("__gap BETWEEN 1 AND 60")
    fourth = plays.where((F.col("down") == 4) & (F.col("ydstogo") <= 5) & F.col("wp").between(0.1, 0.9))
    runs = plays.where(is_designed_run()).groupBy(person, "posteam", "season", "week", "game_id", "rusher_id").agg(F.count(F.lit(1)).alias("n")).groupBy(person, "posteam", "season", "week", "game_id").agg(F.max("n").alias("top"), F.sum("n").alias("all_runs")).where(F.col("all_runs") >= min_runs)
    out = obs(scr.where("pass_oe IS NOT NULL"), "proe", zone, F.col("pass_oe"))
    for part in (
        obs(neutral, "pass_rate", F.lit("all"), f("pass_attempt").cast("int")),
        obs(paced, "pace", F.lit("all"), F.col("__gap")),
        obs(fourth, "go", F.col("ydstogo").cast("string"), (f("pass_attempt") | f("rush_attempt")).cast("int")),
        obs(runs, "concentration", F.lit("all"), F.col("top") / F.col("all_runs")),
        obs(plays.where(is_target()), "te_target", F.lit("all"), (F.col("receiver_position") == "TE").cast("int")),
    ):
        out = out.unionByName(part)
    return out


def reserve_as_of(players: DataFrame, rosters: DataFrame) -> DataFrame:
    """Whether the latest roster at or before the week had the player on reserve."""
    r = rosters.withColumn("reserve", on_reserve(F.col("status"), F.col("status_description_abbr")))
    return asof_join(players, r, ["season", "player_id"], "week", ["reserve"], strict=False)


def relief(plays: DataFrame, least: int = 5, lead: int = 17) -> DataFrame:
    """Per game and team: who took the first dropback, and those who relieved with enough of them unless far ahead."""
    d = spread(plays.where(f("qb_dropback")), "game_id", "posteam")
    first = d.groupBy("season", "week", "game_id", "posteam").agg(F.min_by("passer_id", "play_id").alias("starter"), F.count(F.lit(1)).alias("team_dropbacks"))
    per = d.groupBy("game_id", "posteam", "passer_id").agg(F.count(F.lit(1)).alias("dropbacks"), F.min_by("score_differential", "play_id").alias("entered_at"))
    j = per.join(first, ["game_id", "posteam"])
    return j.withColumn("started", F.col("passer_id") == F.col("starter")).withColumn("relieved", (F.col("passer_id") != F.col("starter")) & (F.col("dropbacks") >= least) & (F.col("entered_at") < lead)).withColumn("share", F.col("dropbacks") / F.col("team_dropbacks"))


def starter_experience(starts: DataFrame, group: str, person: str, season: str, week: str, most: int = 48) -> DataFrame:
    """Starts before this one over all seasons (capped), those of this season's share, and whether the starter changed."""
    t = F.col(season) * 100 + F.col(week)
    rows = starts.withColumn("__t", t)
    own, team = Window.partitionBy(person).orderBy("__t"), Window.partitionBy(group).orderBy("__t")
    this = Window.partitionBy(person, season).orderBy("__t")
    played = F.row_number().over(Window.partitionBy(group, season).orderBy("__t")) - 1
    return rows.withColumn("starts_before", F.least(F.row_number().over(own) - 1, F.lit(most))).withColumn("changed", F.lag(person).over(team) != F.col(person)).withColumn("season_share", F.when(played > 0, (F.row_number().over(this) - 1) / played)).drop("__t")


def regulars_out(regulars: DataFrame, status: DataFrame, group: str, on: str, entity: str) -> DataFrame:
    """Counts of a group's regulars who are out or questionable."""
    j = regulars.join(status.select(on, entity, "availability"), [on, entity], "left")
    return j.groupBy(group, on).agg(F.count_if(F.col("availability") == "out").alias("regulars_out"), F.count_if(F.col("availability") == "questionable").alias("regulars_questionable"))


def weighted_as_of(rows: DataFrame, by: Sequence[str], on: str, value: str, weight: str) -> Column:
    """Weighted mean of earlier rows."""
    w = Window.partitionBy(*by).orderBy(on).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(F.when(F.col(value).isNotNull(), F.col(weight))).over(w)
    return F.when(total > 0, F.sum(F.col(value) * F.col(weight)).over(w) / total)


def prior_and_to_date(rows: DataFrame, by: Sequence[str], season: str, on: str, num: str, den: str, n0: float) -> DataFrame:
    """A rate over the league's mean to date, shrunk, beside the season before's."""
    now = as_of_sums(rows, [*by, season], on, [num, den])
    league = league_to_date(rows, on, [num, den], [season])
    year = rows.groupBy(*by, season).agg(F.sum(num).alias("__x"), F.sum(den).alias("__n"))
    mean = rows.groupBy(season).agg((F.sum(num) / F.sum(den)).alias("__m"))
    prior = year.join(mean, season).select(*by, (F.col(season) + 1).alias(season), ((F.col("__x") - F.col("__n") * F.col("__m")) / (F.col("__n") + n0)).alias("prior"))
    m = F.when(F.col(f"{den}_lg") > 0, F.col(f"{num}_lg") / F.col(f"{den}_lg"))
    return now.join(league, [season, on]).join(prior, [*by, season], "left").withColumn("to_date", (F.col(f"{num}_std") - F.col(f"{den}_std") * m) / (F.col(f"{den}_std") + n0))


def split_means(rows: DataFrame, by: Sequence[str], side: str, value: str, n0: float) -> DataFrame:
    """Means under each of two conditions, shrunk to the mean of all, and their difference (coverage splits)."""
    w = Window.partitionBy(side)
    per = rows.groupBy(*by, side).agg(F.sum(value).alias("__x"), F.count(value).alias("__n")).withColumn("__m", F.sum("__x").over(w) / F.sum("__n").over(w)).withColumn("__v", (F.col("__x") + n0 * F.col("__m")) / (F.col("__n") + n0))
    return per.groupBy(*by).agg(F.max(F.when(F.col(side) == 1, F.col("__v"))).alias("with"), F.max(F.when(F.col(side) == 0, F.col("__v"))).alias("without")).withColumn("split", F.col("with") - F.col("without"))


def luck(rows: DataFrame, by: Sequence[str], season: str, on: str, worthy: str, actual: str, chances: str, n0: float) -> DataFrame:
    """Worthy events over the league to date, and worthy less actual: what should even out."""
    got = as_of_sums(rows, [*by, season], on, [worthy, actual, chances])
    league = league_to_date(rows, on, [worthy, actual, chances], [season])
    j = got.join(league, [season, on])
    over = lambda c: (F.col(f"{c}_std") - F.col(f"{chances}_std") * F.col(f"{c}_lg") / F.col(f"{chances}_lg")) / (F.col(f"{chances}_std") + n0)
    return j.withColumn("worthy_over", over(worthy)).withColumn("luck", over(worthy) - over(actual))


def per_game_rates(rows: DataFrame, by: Sequence[str], season: str, on: str, cols: Sequence[str], last: int = 3) -> DataFrame:
    """Events a game to date, over the last games, and in the season before."""
    got = as_of_sums(rows, [*by, season], on, cols, last)
    year = rows.groupBy(*by, season).agg(F.countDistinct(on).alias("__g"), *[F.sum(c).alias(f"__{c}") for c in cols])
    prior = year.select(*by, (F.col(season) + 1).alias(season), *[(F.col(f"__{c}") / F.col("__g")).alias(f"{c}_prior") for c in cols])
    rate = {f"{c}_rate": F.when(F.col("games") > 0, F.col(f"{c}_std") / F.col("games")) for c in cols}
    recent = {f"{c}_rate_l{last}": F.when(F.col("games") > 0, F.col(f"{c}_l{last}") / F.least(F.col("games"), F.lit(last))) for c in cols}
    return got.join(prior, [*by, season], "left").withColumns({**rate, **recent})


def career_deviation(rows: DataFrame, person: str, season: str, dev: str, n: str) -> DataFrame:
    """A person's sums over earlier seasons, whatever group they were with."""
    year = rows.groupBy(person, season).agg(F.sum(dev).alias("__d"), F.sum(n).alias("__n"))
    w = Window.partitionBy(person).orderBy(season).rowsBetween(Window.unboundedPreceding, -1)
    return year.select(person, season, F.sum("__d").over(w).alias("career_dev"), F.sum("__n").over(w).alias("career_n"))


def group_share_to_date(rows: DataFrame, entity: str, group: str, season: str, on: str, col: str) -> DataFrame:
    """An entity's share of all its group's events before the period, games it missed included."""
    own = as_of_sums(rows.groupBy(entity, group, season, on).agg(F.sum(col).alias("own")), [entity, group, season], on, ["own"])
    per = rows.groupBy(group, season, on).agg(F.sum(col).alias("team"))
    team = as_of_sums(per, [group, season], on, ["team"]).select(group, season, on, "team_std")
    return own.join(team, [group, season, on]).select(entity, group, season, on, F.when(F.col("team_std") > 0, F.coalesce("own_std", F.lit(0)) / F.col("team_std")).alias("share"))


def last_group_game(rows: DataFrame, entity: str, group: str, on: str, col: str) -> DataFrame:
    """The value in the group's previous period, 0 where the entity had none there, null in the group's first."""
    calendar = rows.select(group, on).distinct().withColumn("__before", F.lag(on).over(Window.partitionBy(group).orderBy(on)))
    was = rows.groupBy(entity, group, F.col(on).alias("__before")).agg(F.sum(col).alias("__v"))
    return rows.join(calendar, [group, on]).join(was, [entity, group, "__before"], "left").withColumn("last_game", F.when(F.col("__before").isNotNull(), F.coalesce("__v", F.lit(0)))).drop("__before", "__v")


def run_kinds(plays: DataFrame, by: Sequence[str], goal_line: int = 5) -> DataFrame:
    """Runs by situation: designed, scrambles, sneaks (designed, at most one yard to go, by the passer) and near the goal."""
    kinds = {"designed": is_designed_run(), "scrambles": is_scramble(), "sneaks": is_designed_run() & (F.col("ydstogo") <= 1) & (F.col("rusher_id") == F.col("passer_id")), "goal_line": is_designed_run() & (F.col("yardline_100") <= goal_line)}
    return plays.groupBy(*by).agg(*[F.count_if(F.coalesce(p, F.lit(False))).alias(k) for k, p in kinds.items()])


def kicker_features(games: DataFrame, season: str, on: str) -> DataFrame:
    """A kicker's own points per game and the team's tries per game before each game."""
    own = as_of_sums(games, ["kicker", season], on, ["points"])
    team = as_of_sums(games.groupBy("team", season, on).agg(F.sum("tries").alias("tries")), ["team", season], on, ["tries"]).select("team", season, on, F.when(F.col("games") > 0, F.col("tries_std") / F.col("games")).alias("team_tries"))
    return own.join(team, ["team", season, on]).withColumn("own_ppg", F.when(F.col("games") > 0, F.col("points_std") / F.col("games")))


def games_from_two(box: DataFrame, snaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Games an entity played by either source, with those that say so."""
    both = box.select(*keys, F.lit(1).alias("__b"), F.lit(0).alias("__s")).unionByName(snaps.select(*keys, F.lit(0).alias("__b"), F.lit(1).alias("__s")))
    return both.groupBy(*keys).agg(F.max("__b").alias("in_box"), F.max("__s").alias("in_snaps"))
