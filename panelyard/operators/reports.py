"""Report tables: gradings over seasons, review cuts, game-day states and records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators.evaluation import common_rows, errors, pairwise, spearman
from panelyard.operators.panels import latest_by_key, top_k

# ---- evaluation


def pairs_by(df: DataFrame, a: str, b: str, actual: str, by: Sequence[str], entity: str, attribute: Column) -> DataFrame:
    """Pairs within bounded groups, grouped by an attribute of the pair (``x`` and ``y`` name its sides): how often each system is right and how often they disagree."""
    x, y = df.alias("x"), df.alias("y")
    on = F.col(f"x.{entity}") < F.col(f"y.{entity}")
    for c in by:
        on = on & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    way = F.signum(F.col(f"x.{actual}") - F.col(f"y.{actual}"))
    side = lambda s: F.signum(F.col(f"x.{s}") - F.col(f"y.{s}"))
    p = x.join(y, on).where(way != 0).select(attribute.alias("attribute"), (side(a) == way).alias("ra"), (side(b) == way).alias("rb"), (side(a) != side(b)).alias("differ"))
    n = F.count(F.lit(1))
    return p.groupBy("attribute").agg(n.alias("pairs"), (F.count_if("ra") / n).alias(a), (F.count_if("rb") / n).alias(b), (F.count_if("differ") / n).alias("disagree"), (F.count_if(F.col("differ") & F.col("ra")) / F.when(F.count_if("differ") > 0, F.count_if("differ"))).alias(f"{a}_right_where_apart"))


def shoot_out(df: DataFrame, systems: Sequence[str], actual: str, eligible: Column, category: str, period: str) -> DataFrame:
    """Every system on the rows that all of them and the outcome have, before kickoff and not withheld: errors and pairwise share."""
    rows = common_rows(df.where(eligible), systems, actual)
    e = errors(rows, systems, actual)
    parts = [pairwise(rows, s, actual, [category, period]).agg(F.sum("pairs").alias("pairs"), (F.sum("right") / F.sum("pairs")).alias("pairwise")).select(F.lit(s).alias("system"), "pairs", "pairwise") for s in systems]
    return e.join(reduce(DataFrame.unionByName, parts), "system")


def z_statistics(df: DataFrame, z: Column, x: str, y: str) -> DataFrame:
    """Spread of standardised errors, plain and robust, and the slope of outcome on prediction."""
    s = df.withColumn("__z", z)
    med = s.agg(F.median("__z").alias("__med"))
    return s.join(F.broadcast(med)).agg(F.count("__z").alias("n"), F.stddev_samp("__z").alias("sd"), (F.median(F.abs(F.col("__z") - F.col("__med"))) * 1.4826).alias("robust_sd"), F.regr_slope(y, x).alias("slope"), F.corr(x, y).alias("r"))  # one row


def lines_check(df: DataFrame, mean: str, sd: str, actual: str, offsets: Sequence[float]) -> DataFrame:
    """Stated P(over) at lines set off from the mean against how often the outcome was over."""
    from panelyard.functions.scalars import normal_cdf

    rows = df.dropna(subset=[mean, sd, actual])
    stated = lambda o: 1 - normal_cdf(F.lit(float(o)))
    cells = F.array(*[F.struct(F.lit(float(o)).alias("offset"), stated(o).alias("p"), (F.col(actual) > F.col(mean) + o * F.col(sd)).cast("int").alias("over")) for o in offsets])
    return rows.select(F.inline(cells)).groupBy("offset").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("stated"), F.avg("over").alias("observed"))


def availability_scores(stated: DataFrame, taken: DataFrame) -> DataFrame:
    """Brier score of P(still there at a pick) over entities and picks: ``stated`` (entity, pick, p), ``taken`` (entity, pick_taken)."""
    y = F.when(F.col("pick_taken").isNull() | (F.col("pick_taken") >= F.col("pick")), 1.0).otherwise(0.0)
    return stated.join(taken, "entity", "left").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("p") - y) * (F.col("p") - y)).alias("brier"))


def union_of_tops(df: DataFrame, systems: Sequence[str], category: str, entity: str, k: int) -> DataFrame:
    """Rows in any system's first ``k`` of their category."""
    tops = [top_k(df.where(F.col(s).isNotNull()), [category], [F.desc(s), F.col(entity)], k).select(category, entity) for s in systems]
    return df.join(reduce(DataFrame.union, tops).distinct(), [category, entity], "left_semi")


def at_cuts(df: DataFrame, systems: Sequence[str], actual: str, category: str, entity: str, k: int) -> DataFrame:
    """Rank correlation of each system on the union of all systems' tops."""
    rows = union_of_tops(df, [*systems, actual], category, entity, k)
    return reduce(DataFrame.unionByName, [spearman(rows, s, actual, [category]).withColumn("system", F.lit(s)) for s in systems])


def adjustments(df: DataFrame, base: str, adjusted: str, actual: str, by: Sequence[str] = ()) -> DataFrame:
    """Size of an adjustment, how it goes with what was missing, and how often it goes the right way."""
    d, miss = F.col(adjusted) - F.col(base), F.col(actual) - F.col(base)
    moved = df.withColumn("__d", d).withColumn("__m", miss)
    return moved.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("__d")).alias("mean_size"), F.corr("__d", "__m").alias("r"), F.regr_slope("__m", "__d").alias("slope"), (F.count_if(F.signum("__d") == F.signum("__m")) / F.when(F.count_if(F.col("__d") != 0) > 0, F.count_if(F.col("__d") != 0))).alias("right_way"))


def card(graded: DataFrame, systems: Sequence[str]) -> DataFrame:
    """Season lines: the latest grading of each week, weekly means weighted by their pairs and rows."""
    weeks = latest_by_key(graded, ["season", "week"], [F.desc("graded_at")])
    pooled = lambda c, n: (F.sum(F.col(c) * F.col(n)) / F.sum(F.when(F.col(c).isNotNull(), F.col(n)))).alias(c)
    return weeks.groupBy("season").agg(F.count(F.lit(1)).alias("weeks"), F.sum("pairs").alias("pairs"), *[x for s in systems for x in (pooled(f"{s}_pairwise", "pairs"), pooled(f"{s}_mae", "rows"))])


def absent_from_feed(pool: DataFrame, feed: DataFrame, played: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows missing from the feed against whether they played: a two-by-two count."""
    f = feed.select(*key).distinct().withColumn("in_feed", F.lit(1))
    p = played.select(*key).distinct().withColumn("did_play", F.lit(1))
    j = pool.select(*key).distinct().join(f, list(key), "left").join(p, list(key), "left").fillna(0, ["in_feed", "did_play"])
    return j.groupBy("in_feed", "did_play").agg(F.count(F.lit(1)).alias("n"))


def theory_scores(df: DataFrame, actual: str, low: str, mid: str, high: str, by: Sequence[str], level: float = 0.8) -> DataFrame:
    """Pinball losses, coverage and width of an interval by model."""
    from panelyard.operators.probability import pinball

    y = F.col(actual)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(pinball(y, F.col(low), (1 - level) / 2)).alias("pinball_low"), F.avg(pinball(y, F.col(mid), 0.5)).alias("pinball_mid"), F.avg(pinball(y, F.col(high), (1 + level) / 2)).alias("pinball_high"), F.avg(((y >= F.col(low)) & (y <= F.col(high))).cast("int")).alias("covered"), F.avg(F.col(high) - F.col(low)).alias("width"))


def roll_up(results: DataFrame) -> DataFrame:
    """One row an experiment from nested results: folds, folds better on both measures, mean gains, verdict."""
    f = results.select("name", F.explode("folds").alias("f")).select("name", "f.*")
    both = (F.col("pairwise") > F.col("base_pairwise")) & (F.col("mae") < F.col("base_mae"))
    return f.groupBy("name").agg(F.count(F.lit(1)).alias("folds"), F.count_if(both).alias("better"), F.avg(F.col("pairwise") - F.col("base_pairwise")).alias("pairwise_gain"), F.avg(F.col("mae") - F.col("base_mae")).alias("mae_change"), F.bool_and(both).alias("accepted"))


def reproduced(stored: DataFrame, again: DataFrame, key: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Whether a re-run equals a stored table within the tolerance: rows on one side only, the largest gap."""
    a, b = stored.select(*key, F.col(value).alias("__a"), F.lit(1).alias("__l")), again.select(*key, F.col(value).alias("__b"), F.lit(1).alias("__r"))
    j = a.join(b, list(key), "full")
    odd = F.col("__l").isNull() | F.col("__r").isNull() | ~F.col("__a").isNull().eqNullSafe(F.col("__b").isNull())
    gap = F.max(F.abs(F.col("__a") - F.col("__b")))
    return j.agg(F.count(F.lit(1)).alias("rows_compared"), F.count_if(odd).alias("on_one_side"), gap.alias("largest_gap")).withColumn("same", (F.col("on_one_side") == 0) & (F.coalesce("largest_gap", F.lit(0.0)) <= tolerance))


def ledger_row(graded: DataFrame, systems: Sequence[str]) -> DataFrame:
    """One wide row a week: each system's measures side by side."""
    return graded.groupBy("season", "week").pivot("system", list(systems)).agg(F.max("pairwise").alias("pairwise"), F.max("mae").alias("mae"))


def eligible_pool(board: DataFrame, games: DataFrame, built_at: str) -> DataFrame:
    """Rows of a dated board whose game had not begun when it was built."""
    return board.join(games.select("team", "week", "kickoff"), ["team", "week"]).where(F.col("kickoff") > F.col(built_at))


def walk_forward(facts: DataFrame, entity: str, on: str, x: str) -> DataFrame:
    """Every period's mean of earlier ones against its outcome, errors by period: one windowed pass in place of a loop."""
    w = Window.partitionBy(entity).orderBy(on).rowsBetween(Window.unboundedPreceding, -1)
    p = facts.withColumn("__p", F.sum(x).over(w) / F.count(x).over(w)).where("__p IS NOT NULL")
    d = F.col("__p") - F.col(x)
    return p.groupBy(on).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.abs(d)) / F.count(F.lit(1))).alias("mae"), (F.sum(d) / F.count(F.lit(1))).alias("bias"))


def totals_and_margins(rows: DataFrame, group: Sequence[str], period: str, value: str, pairings: DataFrame, close: float) -> tuple[DataFrame, DataFrame]:
    """Spread of group totals, and the margins of paired groups with the share of close ones."""
    t = rows.groupBy(*group, period).agg(F.sum(value).alias("total"))
    spread = t.agg(F.count(F.lit(1)).alias("n"), F.avg("total").alias("mean"), F.stddev_samp("total").alias("sd"), F.median("total").alias("median"), F.percentile("total", F.lit(0.9)).alias("p90"))
    a = t.select(*[F.col(c).alias(f"{c}_a") for c in group], period, F.col("total").alias("ta"))
    b = t.select(*[F.col(c).alias(f"{c}_b") for c in group], period, F.col("total").alias("tb"))
    m = pairings.join(a, [*[f"{c}_a" for c in group], period]).join(b, [*[f"{c}_b" for c in group], period]).withColumn("margin", F.abs(F.col("ta") - F.col("tb")))
    return spread, m.agg(F.count(F.lit(1)).alias("games"), F.avg("margin").alias("mean_margin"), (F.count_if(F.col("margin") <= close) / F.count(F.lit(1))).alias("close_share"))


def worst(rows: DataFrame, gap: Column, k: int, tie: str) -> DataFrame:
    """The ``k`` rows with the largest differences."""
    return rows.withColumn("gap", gap).orderBy(F.desc(F.abs("gap")), tie).limit(k)


# ---- decisions


def protected(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that may not be dropped with every rule that holds them, and the rest as droppable."""
    why = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))
    return rows.withColumn("held_by", why).withColumn("droppable", F.size("held_by") == 0)


def coverage_of_pool(board: DataFrame, category: str, verdicts: Sequence[str]) -> DataFrame:
    return board.groupBy(category).pivot("verdict", list(verdicts)).agg(F.count(F.lit(1))).fillna(0)


def behind(vacancies: DataFrame, charts: DataFrame, work: DataFrame, take: int = 2) -> DataFrame:
    """Those next in line for vacated work: by chart, then by their own work.

    A vacancy passes over its own entity alone, so only the first places of a
    team's category can be next in line, not all of its chart: ``take`` rows of
    an entity at most, and of these twice ``take``.
    """
    order = [F.col("depth").asc_nulls_last(), F.desc_nulls_last("work"), F.col("entity")]
    line = charts.where("entity IS NOT NULL").join(work, "entity", "left")
    own = top_k(line, ["team", "category", "entity"], order, take).drop("rank")
    first = top_k(own, ["team", "category"], order, 2 * take).drop("rank")
    j = vacancies.select("team", "category", F.col("entity").alias("away")).join(first, ["team", "category"]).where("entity <> away")
    return top_k(j, ["team", "category", "away"], order, take)


def notable_free(stats: DataFrame, drops: DataFrame, held: DataFrame, now: Column, ranks: Mapping[str, int], min_games: int = 4, days: int = 10) -> DataFrame:
    """Free entities who were starters last season or this, or were dropped within the days."""
    limit = F.coalesce(*[F.when(F.col("category") == k, F.lit(v)) for k, v in ranks.items()], F.lit(0))
    rank = F.when(F.col("games") >= min_games, F.rank().over(Window.partitionBy("category", F.col("games") >= min_games).orderBy(F.desc("ppg"))))
    s = stats.withColumn("rank", rank).join(held.select("entity").distinct(), "entity", "left_anti").join(drops, "entity", "left")
    recent = F.col("dropped_at") >= now - F.expr(f"INTERVAL {days} DAYS")
    why = F.array_compact(F.array(F.when(F.col("rank") <= limit, F.lit("starter")), F.when(recent, F.lit("dropped"))))
    return s.withColumn("why", why).where(F.size("why") > 0)


def reserve_traps(rosters: DataFrame, tags: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Entities in a reserve slot whose tag does not allow it."""
    return rosters.where("on_reserve").join(tags.where(F.col("tag").isin(*allowed)).select("entity"), "entity", "left_anti")


def action_order(actions: DataFrame) -> DataFrame:
    """Urgency first (an unknown deadline before all others), then size."""
    bucket = F.when(F.col("deadline").isNull(), 0).when(F.col("hours_left") <= 3, 1).when(F.col("hours_left") <= 24, 2).otherwise(3)
    return actions.withColumn("urgency", bucket).withColumn("place", F.row_number().over(Window.partitionBy("roster").orderBy("urgency", F.desc_nulls_last("z"), "action")))


def absent_reason(rows: DataFrame, feed: DataFrame, complete: DataFrame) -> DataFrame:
    """Abstention for rows that a complete, fresh feed leaves out: ``complete`` says per category whether the feed has as many as it should."""
    gone = rows.join(feed.select("entity").distinct().withColumn("__in", F.lit(True)), "entity", "left").join(complete, "category", "left")
    return gone.withColumn("abstain", F.when(F.col("__in").isNull() & F.col("is_complete"), "absent from a complete feed").when(F.col("__in").isNull(), "feed incomplete")).drop("__in")


def pinned(records: DataFrame, cutoffs: DataFrame, same: Sequence[str]) -> DataFrame:
    """The latest record of each week built before its cutoff with the same identity tags."""
    j = records.join(cutoffs, ["season", "week", *same]).where("built_at < cutoff")
    return latest_by_key(j, ["season", "week", *same], [F.desc("built_at")])


def newest_statement(records: DataFrame, key: Sequence[str]) -> DataFrame:
    """The newest record that states each distinct action."""
    return latest_by_key(records, key, [F.desc("built_at")])


def judged_again(actions: DataFrame, status: DataFrame) -> DataFrame:
    """Archived actions against the state of things now."""
    a = status.select(F.col("entity").alias("into"), F.col("lock").alias("into_lock"), F.col("availability").alias("into_availability"))
    b = status.select(F.col("entity").alias("out"), F.col("lock").alias("out_lock"))
    j = actions.join(a, "into", "left").join(b, "out", "left")
    return j.withColumn("now", F.when(F.col("into_availability") == "out", "withdrawn: not playing").when((F.col("into_lock") == "LOCKED") | (F.col("out_lock") == "LOCKED"), "too late").when(F.col("into_lock").isNull() | F.col("out_lock").isNull(), "unknown").otherwise("stands"))


def side_totals(starters: DataFrame, by: Sequence[str]) -> DataFrame:
    """Points by side with counts by game state; what is unknown is counted, not added."""
    value = F.coalesce("override", "points")
    return starters.groupBy(*by).agg(F.sum(F.when(F.col("state") != "unknown", value)).alias("points"), F.sum(F.when(F.col("state") == "pre", F.col("projection"))).alias("to_come"), *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("pre", "live", "final", "unknown")])


def settled(totals: DataFrame, matchup: str, side: str) -> DataFrame:
    """Whether a lead can no longer change: both sides have only finished games."""
    w = Window.partitionBy(matchup).orderBy(side)
    j = totals.withColumn("other", F.lead("points").over(w)).withColumn("open_all", F.col("n_pre") + F.col("n_live") + F.col("n_unknown") + F.lead(F.col("n_pre") + F.col("n_live") + F.col("n_unknown")).over(w)).where("other IS NOT NULL")
    return j.select(matchup, (F.col("points") - F.col("other")).alias("lead"), (F.col("open_all") == 0).alias("settled"))


def against_trend(swaps: DataFrame, trends: DataFrame) -> DataFrame:
    """Preferred entities whose usage trend is worse than that of those they replace."""
    order = lambda c: F.element_at(F.create_map(F.lit("FALLING"), F.lit(0), F.lit("STEADY"), F.lit(1), F.lit("MIXED"), F.lit(1), F.lit("RISING"), F.lit(2)), F.col(c))
    a = trends.select(F.col("entity").alias("into"), F.col("trend").alias("into_trend"))
    b = trends.select(F.col("entity").alias("out"), F.col("trend").alias("out_trend"))
    return swaps.join(a, "into").join(b, "out").where(order("into_trend") < order("out_trend"))


def weakest_starters(lineup: DataFrame, roster: Sequence[str], slots: Sequence[str], value: str, entity: str) -> DataFrame:
    """The weakest value of each slot; an empty slot is 0."""
    have = lineup.where("slot IS NOT NULL").groupBy(*roster, "slot").agg(F.min(value).alias("weakest"), F.min_by(entity, F.struct(value, entity)).alias("entity"))
    grid = lineup.select(*roster).distinct().withColumn("slot", F.explode(F.array(*[F.lit(s) for s in slots])))
    return grid.join(have, [*roster, "slot"], "left").fillna(0, ["weakest"])


def decision_window(locks: DataFrame, roster: Sequence[str], week: int) -> DataFrame:
    """This week while anything of a roster is open, else the next; and what waits."""
    return locks.groupBy(*roster).agg(F.bool_or(F.col("lock") == "OPEN").alias("open"), F.count_if(F.col("lock") == "UNKNOWN").alias("waiting")).withColumn("decide_week", F.when(F.col("open"), F.lit(week)).otherwise(F.lit(week + 1)))


def retained(lineup: DataFrame, current: DataFrame, roster: Sequence[str], entity: str) -> DataFrame:
    """Keeps starters of the new lineup in the slot they hold now where the new lineup has that slot for them: slots of equal entities are swapped back.

    A roster's lineup is a bounded group (its slots), handled one roster at a time.
    """
    kinds = dict(lineup.dtypes)
    names = [*roster, entity, "slot"]

    def keep(pdf):
        pdf = pdf.sort_values(entity).reset_index(drop=True)
        free = pdf["slot"].tolist()
        out = [None] * len(pdf)
        for k, (now, flexible) in enumerate(zip(pdf["now"], pdf["can"], strict=True)):
            if now in free and now in flexible:
                out[k] = now
                free.remove(now)
        todo = sorted((k for k in range(len(pdf)) if out[k] is None), key=lambda k: len(pdf["can"][k]))
        for k in todo:
            s = next((x for x in free if x in pdf["can"][k]), free[0])
            out[k] = s
            free.remove(s)
        return pdf.assign(slot=out)[names]

    j = lineup.where("slot IS NOT NULL").join(current.select(*roster, entity, F.col("slot").alias("now")), [*roster, entity], "left")
    return j.select(*names, "now", "can").groupBy(*roster).applyInPandas(keep, ", ".join(f"{c} {kinds[c]}" for c in names))


# ---- quality


def first_expiry(sources: DataFrame) -> DataFrame:
    """The source that goes stale first, and when."""
    return sources.where("expires IS NOT NULL").agg(F.min("expires").alias("expires"), F.min_by("source", F.struct("expires", "source")).alias("source"))


def finality(games: DataFrame, by: Sequence[str], score: Column, kickoff: str, now: Column, hours: int = 6) -> DataFrame:
    """Whether all scores are in, and how many are overdue."""
    late = score.isNull() & (F.unix_micros(F.col(kickoff)) < F.unix_micros(now) - hours * 3_600_000_000)
    return games.groupBy(*by).agg(F.bool_and(score.isNotNull()).alias("final"), F.count_if(late).alias("overdue"))


def contradictions(games: DataFrame, week: Sequence[str], teams: Sequence[str], kickoff: str) -> DataFrame:
    """Teams with two games in a week, and games without a readable time."""
    both = games.select(*week, kickoff, F.explode(F.array(*teams)).alias("team"))
    twice = both.groupBy(*week, "team").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*week, "team", F.lit("two games").alias("fault"))
    return twice.unionByName(both.where(F.col(kickoff).isNull()).select(*week, "team", F.lit("no time").alias("fault")))


def degradations(sources: DataFrame, gaps: DataFrame) -> DataFrame:
    """Everything stale, missing or gapped in a run."""
    a = sources.where("state <> 'FRESH'").select("source", F.col("state").alias("fault"), "reason")
    return a.unionByName(gaps.where("missing <> ''").select("source", F.lit("GAPPED").alias("fault"), F.concat(F.lit("periods "), F.col("missing")).alias("reason")))
