"""Feature blocks and tables composed from the other operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.scalars import normal_cdf
from panelyard.operators.evaluation import errors, pairwise
from panelyard.operators.market import consensus, devig
from panelyard.operators.panels import as_of_sums, asof_join, league_to_date, role_label
from panelyard.operators.scored import OFFENSE, weighted_score

# ---- sources and scores


def projection_feed(feed: DataFrame, names: Mapping[str, str], kickoffs: DataFrame) -> DataFrame:
    """A provider's stat lines under our names, scored, with whether they were stated before kickoff."""
    own = feed.select(*[F.col(c).alias(names.get(c, c)) for c in feed.columns])
    return own.withColumn("points", weighted_score(own.columns, OFFENSE)).join(kickoffs.select("team", "week", "kickoff"), ["team", "week"], "left").withColumn("in_time", F.col("as_of") < F.col("kickoff"))


def rederived(raw: DataFrame, identities: DataFrame, name: str, entity: str) -> DataFrame:
    """A derived table made again from the raw archive with today's identities: one quote table per known id."""
    known = identities.groupBy(name).agg(F.countDistinct(entity).alias("__n"), F.min(entity).alias(entity)).where("__n = 1").drop("__n")
    return raw.join(known, name)


def expected_share(expected: DataFrame, names: Mapping[str, str], team: str, by: Sequence[str]) -> DataFrame:
    """Points of expected stats, and each player's share of the team's."""
    own = expected.withColumnsRenamed(dict(names))
    scored = own.withColumn("expected_points", weighted_score(own.columns, OFFENSE))
    total = F.sum("expected_points").over(Window.partitionBy(team, *by))
    return scored.withColumn("expected_share", F.when(total > 0, F.col("expected_points") / total))


def component_points(columns: Sequence[str]) -> dict[str, Column]:
    """Passing, rushing and receiving points as columns of their own."""
    parts = {"pass": ("pass_yd", "pass_td", "interception"), "rush": ("rush_yd", "rush_td"), "receive": ("reception", "rec_yd", "rec_td")}
    return {f"{k}_points": weighted_score(columns, {r: OFFENSE[r] for r in rs}) for k, rs in parts.items()}


def volume_history(team_weeks: DataFrame) -> DataFrame:
    """Plays, pass rate and value per play of each team-week."""
    plays = F.col("attempts") + F.col("carries") + F.col("sacks")
    return team_weeks.withColumn("plays", plays).withColumn("pass_rate", F.when(plays > 0, (F.col("attempts") + F.col("sacks")) / plays)).withColumn("epa_per_play", F.when(plays > 0, F.col("epa") / plays))


def special_events(plays: DataFrame) -> DataFrame:
    """Field goals, tries, kick returns and punt returns as one typed table (kind, team, value, distance)."""
    cols = ["season", "week", "game_id"]
    one = lambda kind, keep, team, value, distance: plays.where(keep).select(*cols, F.lit(kind).alias("kind"), F.col(team).alias("team"), value.cast("double").alias("value"), distance.cast("double").alias("distance"))
    return reduce(
        DataFrame.unionByName,
        [
            one("field_goal", F.col("play_type") == "field_goal", "posteam", (F.col("field_goal_result") == "made").cast("int"), F.col("kick_distance")),
            one("try", F.col("two_point_attempt") == 1, "posteam", (F.col("two_point_conv_result") == "success").cast("int"), F.lit(None)),
            one("kick_return", (F.col("play_type") == "kickoff") & F.col("return_yards").isNotNull(), "posteam", F.col("return_yards"), F.lit(None)),
            one("punt_return", (F.col("play_type") == "punt") & F.col("return_yards").isNotNull(), "defteam", F.col("return_yards"), F.lit(None)),
        ],
    )


def participation_base(rows: DataFrame, crosswalk: DataFrame, key: str, target: str, by: Sequence[str], value: str) -> DataFrame:
    """A per-game base keyed by our id: mapped through the crosswalk, the largest value of each key kept."""
    return rows.join(crosswalk.select(key, target).dropDuplicates([key]), key).groupBy(*by, target).agg(F.max(value).alias(value))


def platform_rows(documents: DataFrame, category: str) -> DataFrame:
    """A platform's nested stats flattened: points, opportunities by category, and the tag."""
    get = lambda k: F.coalesce(F.element_at("stats", k), F.lit(0.0))
    opps = F.when(F.col(category) == "QB", get("pass_att") + get("rush_att")).when(F.col(category) == "RB", get("rush_att") + get("rec_tgt")).otherwise(get("rec_tgt"))
    return documents.select("entity", category, F.element_at("stats", "pts_half_ppr").alias("points"), opps.alias("opportunities"), F.col("injury_status").alias("tag"))


# ---- features


def own_and_opponent(team_weeks: DataFrame, schedule: DataFrame, season: str, on: str, cols: Sequence[str]) -> DataFrame:
    """Means to date of a team and of what its opponent has allowed, on the schedule's rows."""
    w = Window.partitionBy("team", season).orderBy(on)
    run = team_weeks.select("team", season, on, *[(F.sum(c).over(w) / F.count(c).over(w)).alias(f"{c}_mean") for c in cols])
    names = [f"{c}_mean" for c in cols]
    own = asof_join(schedule, run, ["team", season], on, names)
    opp = run.select(F.col("team").alias("opponent"), season, on, *[F.col(n).alias(f"opp_{n}") for n in names])
    return asof_join(own, opp, ["opponent", season], on, [f"opp_{n}" for n in names])


def quarterback_change(starters: DataFrame, catches: DataFrame, season: str, on: str) -> DataFrame:
    """For each receiver and week: whether the expected passer is not last week's, the share with him less the share to date, and earlier games together.

    ``starters`` has team, week and passer; ``catches`` entity, team, week, passer, own, team_n.
    """
    t = Window.partitionBy("team", season).orderBy(on)
    s = starters.withColumn("changed", F.lag("passer").over(t) != F.col("passer"))
    both = catches.groupBy("entity", "team", season, on, "passer").agg(F.sum("own").alias("own"), F.sum("team_n").alias("team_n"))
    wp = Window.partitionBy("entity", "passer", season).orderBy(on)
    together = both.select("entity", "passer", season, on, F.sum("own").over(wp).alias("own_with"), F.sum("team_n").over(wp).alias("team_with"), F.count(F.lit(1)).over(wp).alias("games_with"))
    per = both.groupBy("entity", "team", season, on).agg(F.sum("own").alias("own"), F.sum("team_n").alias("team_n"))
    now = as_of_sums(per, ["entity", season], on, ["own", "team_n"]).join(s, ["team", season, on])
    got = asof_join(now, together, ["entity", "passer", season], on, ["own_with", "team_with", "games_with"])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return got.withColumn("share_delta", share("own_with", "team_with") - share("own_std", "team_n_std")).withColumn("games_with", F.coalesce("games_with", F.lit(0)))


def interaction(a: Column, b: Column, center_a: float = 0.0, center_b: float = 0.0) -> Column:
    """Product of two centred features; null where either is unknown."""
    return (a - center_a) * (b - center_b)


def rate_over_expectation(rows: DataFrame, by: Sequence[str], season: str, on: str, made: str, chances: str, n0: float) -> DataFrame:
    """Made over what the league's rate to date gives for the same chances, shrunk."""
    got = as_of_sums(rows, [*by, season], on, [made, chances])
    lg = league_to_date(rows, on, [made, chances], [season])
    m = F.when(F.col(f"{chances}_lg") > 0, F.col(f"{made}_lg") / F.col(f"{chances}_lg"))
    return got.join(lg, [season, on]).withColumn("over", (F.col(f"{made}_std") - F.col(f"{chances}_std") * m) / (F.col(f"{chances}_std") + n0))


def feature_union(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns of both feature sets on the first one's rows."""
    return a.join(b.select(*keys, *[c for c in b.columns if c not in a.columns]), list(keys), "left")


def early_priors(entities: DataFrame, draft: DataFrame, last: DataFrame, coaches: DataFrame, season: str, start: Column) -> DataFrame:
    """Draft capital, age and its square, last season's rate and a new coach, before the first game."""
    prior = last.select("entity", (F.col(season) + 1).alias(season), F.col("rate").alias("prior_rate"))
    new = coaches.withColumn("new_coach", (F.lag("coach").over(Window.partitionBy("team").orderBy(season)) != F.col("coach")).cast("int")).select("team", season, "new_coach")
    age = F.datediff(start, F.col("born")) / 365.25 - 26
    return entities.join(draft, "entity", "left").join(prior, ["entity", season], "left").join(new, ["team", season], "left").withColumn("capital", -F.log(F.col("pick") + 1.0)).withColumn("age26", age).withColumn("age26_sq", age * age)


def counting_rates(rows: DataFrame, by: Sequence[str], season: str, on: str, cols: Sequence[str], games0: float) -> DataFrame:
    """Per-game rates to date drawn to the season before's, for distributions."""
    got = as_of_sums(rows, [*by, season], on, cols)
    year = rows.groupBy(*by, season).agg(F.countDistinct(on).alias("__g"), *[F.sum(c).alias(f"__{c}") for c in cols])
    prior = year.select(*by, (F.col(season) + 1).alias(season), *[(F.col(f"__{c}") / F.col("__g")).alias(f"__p_{c}") for c in cols])
    j = got.join(prior, [*by, season], "left")
    return j.withColumns({f"{c}_rate": (F.coalesce(f"{c}_std", F.lit(0)) + games0 * F.col(f"__p_{c}")) / (F.col("games") + games0) for c in cols}).drop(*[f"__p_{c}" for c in cols])


# ---- estimators


def evidence(facts: DataFrame, entity: str, group: str, category: str, on: str, through: int, col: str) -> DataFrame:
    """To-date line of each entity: sums, periods, share over the games it played, and its role in the group."""
    past = facts.where(F.col(on) <= through).withColumn("__team", F.sum(col).over(Window.partitionBy(group, on)))
    e = past.groupBy(entity).agg(F.max_by(group, on).alias(group), F.max_by(category, on).alias(category), F.countDistinct(on).alias("periods"), F.sum(col).alias("total"), F.when(F.sum("__team") > 0, F.sum(col) / F.sum("__team")).alias("share"))
    return e.withColumn("role", role_label([group, category], "total", entity, category))


def shape_and_outcome(rosters: DataFrame, outcomes: DataFrame, by: Sequence[str], category: str, kinds: Sequence[str], outcome: str) -> DataFrame:
    """Correlation of each category's count on a roster with how it ended."""
    counts = rosters.groupBy(*by).agg(*[F.count_if(F.col(category) == k).alias(k) for k in kinds]).join(outcomes, list(by))
    wide = counts.agg(*[F.corr(k, outcome).alias(k) for k in kinds])
    return wide.unpivot([], list(kinds), "category", "r")


def training_table(features: DataFrame, baseline: DataFrame, outside: DataFrame, actuals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Features, baseline, outside number and outcome of each entity and period; the outside number may be missing."""
    return features.join(baseline, list(keys)).join(outside, list(keys), "left").join(actuals, list(keys))


def parameter_search(df: DataFrame, grid: Sequence[Mapping[str, float]], score) -> DataFrame:
    """The parameters with the least mean score; all cells are sums of one pass."""
    s = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(score({k: F.lit(float(v)) for k, v in g.items()})).alias(f"c{i}") for i, g in enumerate(grid)])
    best = F.array_min(F.array(*[F.struct((F.col(f"c{i}") / F.col("n")).alias("score"), *[F.lit(float(v)).alias(k) for k, v in g.items()]) for i, g in enumerate(grid)]))
    return s.select("n", best.alias("b")).select("n", "b.*")


def encoded_like(rows: DataFrame, flags: Mapping[str, bool]) -> DataFrame:
    """Nulls as in training: 0 with a known-flag where training had nulls, 0 alone elsewhere."""
    return rows.withColumns({**{f"{c}__known": F.col(c).isNotNull().cast("int") for c, f in flags.items() if f}, **{c: F.coalesce(c, F.lit(0)) for c in flags}})


# ---- market


def payload_summary(quotes: DataFrame) -> DataFrame:
    """Counts only: books, markets, players and quotes of each event."""
    return quotes.groupBy("event_id").agg(F.countDistinct("book").alias("books"), F.countDistinct("market").alias("markets"), F.countDistinct("player").alias("players"), F.count(F.lit(1)).alias("quotes"))


def catalogue(documents: DataFrame) -> DataFrame:
    """A nested market catalogue as a dimension."""
    return documents.select(F.explode("sports").alias("s")).select(F.col("s.key").alias("sport"), F.explode("s.markets").alias("m")).select("sport", F.col("m.key").alias("market"), F.col("m.name").alias("name"))


def slots_to_cover(games: DataFrame, held: DataFrame, leads: Sequence[int]) -> DataFrame:
    """Per season: games, weeks and snapshot instants not yet held."""
    want = games.select("season", "week", "game_id", F.explode(F.array(*[F.lit(x) for x in leads])).alias("lead_minutes"))
    left = want.join(held.select("game_id", "lead_minutes").distinct(), ["game_id", "lead_minutes"], "left_anti")
    return left.groupBy("season").agg(F.countDistinct("game_id").alias("games"), F.countDistinct("week").alias("weeks"), F.count(F.lit(1)).alias("instants"))


def market_view(quotes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Consensus of all events and what was set aside, by reason."""
    main, aside = devig(quotes)
    return consensus(main), aside


# ---- probability and evaluation


def exchange(points: Column, leverage: Column) -> Column:
    """Win probability that points are worth; null where the matchup abstains."""
    return points * leverage


def historical_matchups(starters: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One row a finished matchup with both sides' projected and actual sums; those that cannot be used are counted by reason."""
    s = starters.groupBy(*by, "side").agg(F.sum("projection").alias("mean"), F.sqrt(F.sum(F.col("spread") * F.col("spread"))).alias("sd"), F.sum("actual").alias("actual"), F.count_if(F.col("projection").isNull()).alias("gaps"), F.count_if(F.col("actual").isNull()).alias("open"))
    w = Window.partitionBy(*by).orderBy("side")
    two = s.withColumns({f"{c}_b": F.lead(c).over(w) for c in ("mean", "sd", "actual", "gaps", "open")}).withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    why = F.when(F.col("mean_b").isNull() & F.col("gaps_b").isNull(), "one side only").when(F.col("gaps") + F.col("gaps_b") > 0, "a starter without a projection").when(F.col("open") + F.col("open_b") > 0, "a starter without an outcome")
    judged = two.withColumn("reason", why)
    good = judged.where("reason IS NULL").withColumn("won", F.when(F.col("actual") > F.col("actual_b"), 1.0).when(F.col("actual") < F.col("actual_b"), 0.0).otherwise(0.5))
    return good.drop("reason", "gaps", "gaps_b", "open", "open_b"), judged.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def calibration_study(matchups: DataFrame, season: str, ks: Sequence[float]) -> DataFrame:
    """Log loss of every season at each spread factor, and the factor the other seasons would choose."""
    s = F.sqrt(F.col("sd") * F.col("sd") + F.col("sd_b") * F.col("sd_b"))
    p = lambda k: F.least(F.greatest(normal_cdf((F.col("mean") - F.col("mean_b")) / (s * float(k))), F.lit(1e-6)), F.lit(1 - 1e-6))
    loss = lambda k: -(F.col("won") * F.log(p(k)) + (1 - F.col("won")) * F.log(1 - p(k)))
    per = matchups.groupBy(season).agg(F.count(F.lit(1)).alias("n"), *[F.sum(loss(k)).alias(f"c{i}") for i, k in enumerate(ks)])
    w = Window.partitionBy()  # rows: one for each season
    rest = F.array_min(F.array(*[F.struct((F.sum(f"c{i}").over(w) - F.col(f"c{i}")).alias("l"), F.lit(float(k)).alias("k"), (F.col(f"c{i}") / F.col("n")).alias("held_out")) for i, k in enumerate(ks)]))
    return per.select(season, "n", rest.alias("b")).select(season, "n", F.col("b.k").alias("factor"), F.col("b.held_out").alias("log_loss"))


def checkpoint_clock(games: DataFrame, week: Sequence[str], kickoff: str, hours: Sequence[float]) -> DataFrame:
    """Instants at which a week is looked at, counted from its first kickoff."""
    first = games.groupBy(*week).agg(F.min(kickoff).alias("first"))
    return first.select(*week, F.posexplode(F.array(*[F.timestamp_micros(F.unix_micros("first") + F.lit(int(h * 3_600_000_000))) for h in hours])).alias("checkpoint", "at"))


def distribution_folds(rows: DataFrame, fold: str, models: Mapping[str, Column]) -> DataFrame:
    """Mean score of each distribution by fold, and whether a model is below the first in all of them."""
    names = list(models)
    per = rows.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(m) for m, c in models.items()])
    return per.withColumns({f"{m}_better": F.bool_and(F.col(m) < F.col(names[0])).over(Window.partitionBy()) for m in names[1:]})


def subset_metrics(df: DataFrame, systems: Sequence[str], actual: str, keep: Mapping[str, Column], by: Sequence[str]) -> DataFrame:
    """Errors and pairwise share on named subsets of the rows."""
    out = []
    for name, c in keep.items():
        part = df.where(c)
        pairs = reduce(DataFrame.unionByName, [pairwise(part, s, actual, by).agg(F.sum("pairs").alias("pairs"), (F.sum("right") / F.sum("pairs")).alias("pairwise")).withColumn("system", F.lit(s)) for s in systems])
        out.append(errors(part, systems, actual).join(pairs, "system").withColumn("subset", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


# ---- decisions and changes


def optimiser_rows(pool: DataFrame, crosswalk: DataFrame, projections: DataFrame, locks: DataFrame) -> DataFrame:
    """Pool ids with projection, spread and lock; what is unknown stays null."""
    return pool.join(crosswalk, "platform_id", "left").join(projections, "entity", "left").join(locks, "team", "left")


def action_table(swaps: DataFrame, adds: DataFrame, kickoffs: DataFrame, roster: str) -> DataFrame:
    """Swaps and adds as ranked rows with the deadline of the earlier kickoff and the next best choice of the slot."""
    s = swaps.select(roster, F.lit("swap").alias("kind"), "into", "out", "slot", "gain")
    a = adds.select(roster, F.lit("add").alias("kind"), F.col("add").alias("into"), F.col("sits").alias("out"), "slot", "gain").where("gain > 0")
    rows = s.unionByName(a)
    k = lambda c: kickoffs.select(F.col("entity").alias(c), F.col("kickoff").alias(f"{c}_kickoff"))
    rows = rows.join(k("into"), "into", "left").join(k("out"), "out", "left").withColumn("deadline", F.least("into_kickoff", "out_kickoff"))
    w = Window.partitionBy(roster, "slot").orderBy(F.desc("gain"), "into")
    return rows.withColumn("fallback", F.lead("into").over(w)).withColumn("place", F.row_number().over(Window.partitionBy(roster).orderBy(F.col("deadline").asc_nulls_first(), F.desc("gain"), "into")))


def candidate_record(board: DataFrame, stamps: Mapping[str, Column]) -> DataFrame:
    """The board's candidates with their verdicts and the stamps of what they were judged on."""
    return board.withColumns(dict(stamps)).withColumn("digest", F.sha2(F.to_json(F.struct("*")), 256))


def outscored_on_bench(rows: DataFrame, roster: Sequence[str] | str, category: str) -> DataFrame:
    """Bench entities with more points than a starter of their category, and by how much at most."""
    key = [*([roster] if isinstance(roster, str) else roster), category]
    low = rows.where("slot IS NOT NULL").groupBy(*key).agg(F.min("points").alias("__low"))
    return rows.where("slot IS NULL").join(low, key).where(F.col("points") > F.col("__low")).withColumn("by", F.col("points") - F.col("__low")).drop("__low")


def game_day(lineup: DataFrame, states: DataFrame, roster: Sequence[str], category: str) -> DataFrame:
    """Each roster on game day: starters, points of those whose game is final, those still to come, and bench entities that outscore a starter of their category.

    ``states`` has the entity, what it shares of ``roster``, and ``state``.
    """
    key = [c for c in states.columns if c != "state"]
    now = lineup.join(states, key, "left")
    started = F.col("slot").isNotNull()
    final = F.coalesce(F.col("state") == "final", F.lit(False))
    bench = outscored_on_bench(lineup, [*roster], category).groupBy(*roster).agg(F.count(F.lit(1)).alias("outscored"))
    per = now.groupBy(*roster).agg(F.count_if(started).alias("starters"), F.sum(F.when(started & final, F.col("points"))).alias("final_points"), F.count_if(started & ~final).alias("to_come"))
    return per.join(bench, list(roster), "left").fillna(0, ["outscored"])


def review(usage: DataFrame, rosters: DataFrame, mine, ros: DataFrame) -> dict[str, DataFrame]:
    """Cuts for one manager: own usage, free risers, and free entities worth more over the season than the least of one's own."""
    own = usage.join(rosters.where(F.col("owner") == F.lit(mine)).select("entity"), "entity", "left_semi")
    free = usage.join(rosters.select("entity"), "entity", "left_anti")
    least = ros.join(rosters.where(F.col("owner") == F.lit(mine)).select("entity"), "entity", "left_semi").groupBy("category").agg(F.min("total").alias("my_least"))
    better = ros.join(rosters.select("entity"), "entity", "left_anti").join(least, "category").where(F.col("total") > F.col("my_least"))
    return {"mine": own, "free_rising": free.where("trend = 'RISING'"), "free_better": better}


def transitions(before: DataFrame, after: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Fields that differ between two records, one row each, old and new as text."""
    text = lambda df, n: df.select(*keys, F.explode(F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("string"))])).alias("field", n))
    return text(before, "old").join(text(after, "new"), [*keys, "field"], "full").where(~F.col("old").eqNullSafe(F.col("new")))


def pull_check(manifest: DataFrame, gaps: DataFrame) -> DataFrame:
    """The scoring-input check beside each pull: how many rule terms its schema misses."""
    n = gaps.groupBy("source").agg(F.count(F.lit(1)).alias("terms_missing"))
    return manifest.join(n, "source", "left").fillna(0, ["terms_missing"])


def held_out_coverage(df: DataFrame, period: str, cols: Sequence[str], held_out: Column) -> DataFrame:
    """Share of non-missing values by period and column on held-out rows."""
    wide = df.where(held_out).groupBy(period).agg(*[(F.count(c) / F.count(F.lit(1))).alias(c) for c in cols])
    return wide.unpivot([period], list(cols), "column_name", "coverage")
