"""Filling slots from rosters and judging moves, for all rosters of all leagues at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_lineup(rows: DataFrame, roster: Sequence[str], category: str, value: str, entity: str, slots: Mapping[str, int], flex: Sequence[str], flex_slots: int) -> DataFrame:
    """Each roster's starters: dedicated slots by rank, then the flexible ones from what is left.

    Two ranks over the roster's own rows; rows without a value never start.
    Adds ``slot`` (category, FLEX or null).
    """
    need = F.coalesce(*[F.when(F.col(category) == k, F.lit(n)) for k, n in slots.items()], F.lit(0))
    known = F.col(value).isNotNull()
    k = F.row_number().over(Window.partitionBy(*roster, category).orderBy(F.col(value).desc_nulls_last(), entity))
    first = rows.withColumn("__own", known & (k <= need))
    can = known & ~F.col("__own") & F.col(category).isin(*flex)
    j = F.row_number().over(Window.partitionBy(*roster, can).orderBy(F.col(value).desc_nulls_last(), entity))
    return first.withColumn("slot", F.when(F.col("__own"), F.col(category)).when(can & (j <= flex_slots), "FLEX")).drop("__own")


def swaps(lineup: DataFrame, roster: Sequence[str], category: str, value: str, spread: str, entity: str, flex: Sequence[str]) -> DataFrame:
    """The best single swap for each bench row: the starter it may replace with the largest gain, and the gain in deviations."""
    start = lineup.where("slot IS NOT NULL").select(*roster, "slot", F.col(entity).alias("out"), F.col(value).alias("__v"), F.col(spread).alias("__s"))
    bench = lineup.where("slot IS NULL").where(F.col(value).isNotNull())
    fits = bench.withColumn("slot", F.explode(F.when(F.col(category).isin(*flex), F.array(F.col(category), F.lit("FLEX"))).otherwise(F.array(F.col(category)))))
    gain = F.col(value) - F.col("__v")
    pairs = fits.join(start, [*roster, "slot"]).withColumn("gain", gain).withColumn("z", gain / F.sqrt(F.col(spread) * F.col(spread) + F.col("__s") * F.col("__s")))
    w = Window.partitionBy(*roster, entity).orderBy(F.desc("gain"), "out")
    return pairs.withColumn("__k", F.row_number().over(w)).where("__k = 1").select(*roster, F.col(entity).alias("into"), "out", "slot", "gain", "z")


def add_drop_board(pool: DataFrame, lineup: DataFrame, roster: Sequence[str], category: str, value: str, entity: str, flex: Sequence[str], per_category: int = 12) -> DataFrame:
    """A quick screen: what each of the best free entities of a category has over each roster's weakest starters.

    It looks at filled slots and one drop alone; ``exchange.add_drop_gains`` has
    the gain of the whole lineup, for every free entity and drop.
    The gain of one addition is its value over the weakest starter of a slot
    that takes it; that starter sits down and the least of the bench is dropped.
    """
    top = pool.withColumn("__k", F.row_number().over(Window.partitionBy(category).orderBy(F.desc(value), entity))).where(F.col("__k") <= per_category)
    weakest = lineup.where("slot IS NOT NULL").groupBy(*roster, "slot").agg(F.min(F.struct(F.col(value).alias("v"), F.col(entity).alias("e"))).alias("w"))
    fits = top.select(F.col(entity).alias("add"), F.col(value).alias("__v"), F.explode(F.when(F.col(category).isin(*flex), F.array(F.col(category), F.lit("FLEX"))).otherwise(F.array(F.col(category)))).alias("slot"))
    drop = lineup.where("slot IS NULL").groupBy(*roster).agg(F.min_by(entity, F.struct(F.coalesce(value, F.lit(-1e9)), F.col(entity))).alias("drop"))
    pairs = weakest.join(F.broadcast(fits), "slot").withColumn("gain", F.col("__v") - F.col("w.v"))  # at most per_category rows a category
    best = pairs.groupBy(*roster, "add").agg(F.max(F.struct("gain", "slot", F.col("w.e").alias("sits"))).alias("b"))
    verdict = F.when(F.col("b.gain") > 0, "starts").otherwise("depth")
    return best.join(drop, list(roster), "left").select(*roster, "add", "drop", "b.gain", "b.slot", "b.sits", verdict.alias("verdict"))


def capacity(rosters: DataFrame, roster: Sequence[str], places: Column) -> DataFrame:
    """Open places; null where more are held than there are."""
    return rosters.groupBy(*roster).agg(F.count(F.lit(1)).alias("held")).withColumn("places", places).withColumn("open", F.when(F.col("held") <= F.col("places"), F.col("places") - F.col("held")))


def lock_state(rows: DataFrame, kickoff: str, games: str, now: Column, proven_off: str) -> DataFrame:
    """OPEN, LOCKED or UNKNOWN with the reason."""
    why = F.when(F.col(games) > 1, "several games in the period").when(F.col(kickoff).isNotNull() & (F.col(kickoff) <= now), "started").when(F.col(kickoff).isNotNull(), "not started").when(F.col(games) == 1, "unreadable kickoff").when(F.col(proven_off), "off period proven").otherwise("no game found, and none ruled out")
    state = F.when(why == "started", "LOCKED").when(why.isin("not started", "off period proven"), "OPEN").otherwise("UNKNOWN")
    return rows.withColumn("lock", state).withColumn("lock_reason", why)


def vacancies(facts: DataFrame, entity: str, group: str, on: str, col: str, now: int, floors: Mapping[str, int], category: str, gone: Column) -> DataFrame:
    """Recent work that will not be done: mean of the last two periods of those gone, where it reaches the category's floor."""
    recent = facts.where((F.col(on) > now - 2) & (F.col(on) <= now)).groupBy(entity, group, category).agg((F.sum(col) / 2).alias("work"))
    floor = F.coalesce(*[F.when(F.col(category) == k, F.lit(v)) for k, v in floors.items()], F.lit(1_000_000))
    return recent.where(gone & (F.col("work") >= floor))


def volume_alert(facts: DataFrame, entity: str, category: str, on: str, measures: Mapping[str, Mapping[str, float]], games: int = 3, within: int = 4) -> DataFrame:
    """Entities whose last ``games`` rows all reach their category's thresholds within ``within`` periods; unknown never qualifies."""
    w = Window.partitionBy(entity).orderBy(F.desc(on))
    last = facts.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= games)
    ok = F.lit(True)
    for m, limits in measures.items():
        limit = F.coalesce(*[F.when(F.col(category) == k, F.lit(float(v))) for k, v in limits.items()], F.lit(float("inf")))
        ok = ok & F.coalesce(F.col(m) >= limit, F.lit(False))
    return last.groupBy(entity, category).agg(F.count(F.lit(1)).alias("n"), F.bool_and(ok).alias("ok"), (F.max(on) - F.min(on)).alias("span"), F.max(on).alias("last")).where((F.col("n") == games) & F.col("ok") & (F.col("span") < within)).select(entity, category, "last")


def usage_trend(facts: DataFrame, entity: str, on: str, col: str, window: int = 4, least: int = 3, up: float = 1.25, down: float = 0.75) -> DataFrame:
    """RISING, FALLING or STEADY: mean of the last two rows of the window over that of the rows before."""
    w = Window.partitionBy(entity).orderBy(F.desc(on))
    last = facts.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= window)
    per = last.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.when(F.col("__k") <= 2, F.col(col))) / 2).alias("recent"), (F.sum(F.when(F.col("__k") > 2, F.col(col))) / F.count_if(F.col("__k") > 2)).alias("earlier")).where(F.col("n") >= least)
    ratio = F.when(F.col("earlier") > 0, F.col("recent") / F.col("earlier"))
    return per.withColumn("ratio", ratio).withColumn("trend", F.when(ratio.isNull(), "UNKNOWN").when(ratio >= up, "RISING").when(ratio <= down, "FALLING").otherwise("STEADY"))


def latest_drop(transactions: DataFrame, entity: str, at: str) -> DataFrame:
    """The last completed drop of each entity."""
    return transactions.where("action = 'drop'").groupBy(entity).agg(F.max(at).alias("dropped_at"), F.max_by("roster_id", at).alias("dropped_by"))


def waiver_phase(rows: DataFrame, dropped: str, kickoff: str, now: Column, run_hours: int = 48) -> DataFrame:
    """WAIVERS until so many hours after a drop, LOCKED once the game has begun, else FREE; UNSURE without a kickoff."""
    held = F.col(dropped).isNotNull() & (F.unix_micros(now) < F.unix_micros(F.col(dropped)) + run_hours * 3_600_000_000)
    return rows.withColumn("phase", F.when(F.col(kickoff).isNull(), "UNSURE").when(F.col(kickoff) <= now, "LOCKED").when(held, "WAIVERS").otherwise("FREE"))


def gate(actions: DataFrame, needs: DataFrame, sources: DataFrame) -> DataFrame:
    """Whether every source an action needs is fresh, which are not, and when the first of them expires."""
    j = needs.join(sources, "source", "left")
    per = j.groupBy("action").agg(F.bool_and(F.coalesce(F.col("state") == "FRESH", F.lit(False))).alias("allowed"), F.array_join(F.array_sort(F.collect_set(F.when(F.coalesce(F.col("state") != "FRESH", F.lit(True)), F.col("source")))), ",").alias("blocked_by"), F.min("expires").alias("first_expiry"))
    return actions.join(per, "action", "left")


def main_cutoff(games: DataFrame, by: Sequence[str], kickoff: str) -> DataFrame:
    """First kickoff on the busiest day of each period; the earlier day on a tie."""
    days = games.groupBy(*by, F.to_date(kickoff).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min(kickoff).alias("first"))
    return days.groupBy(*by).agg(F.max_by("first", F.struct("n", -F.unix_date("day"))).alias("cutoff"))


def hold_or_stream(values: DataFrame, category: str, on: str, mine: Column, value: str, entity: str) -> DataFrame:
    """Over a horizon: each period's best of mine and best free, their totals and how often the stream changes hands."""
    best = lambda c: F.max(F.when(c, F.struct(F.col(value).alias("v"), (-F.col(entity)).alias("e"))))
    per = values.groupBy(category, on).agg(best(mine).alias("m"), best(~mine).alias("f"))
    turn = F.when(F.col("f.e") != F.lag("f.e").over(Window.partitionBy(category).orderBy(on)), 1).otherwise(0)
    return per.withColumn("turn", turn).groupBy(category).agg(F.count(F.lit(1)).alias("periods"), F.sum("m.v").alias("hold"), F.sum("f.v").alias("stream"), F.sum("turn").alias("changes"))


def slots_of(rosters: DataFrame, roster: Sequence[str], starters: str, order: Sequence[str]) -> DataFrame:
    """A positional array of starters as slot rows."""
    names = F.array(*[F.lit(s) for s in order])
    return rosters.select(*roster, F.posexplode(starters).alias("place", "entity")).withColumn("slot", F.get(names, F.col("place")))


def needs_met(rows: DataFrame, roster: Sequence[str], category: str, slots: Mapping[str, int], flex: Sequence[str], flex_slots: int) -> DataFrame:
    """Whether the counts of a roster can fill every slot: spare of flexible categories fills the flexible ones."""
    per = rows.groupBy(*roster).agg(*[F.count_if(F.col(category) == c).alias(c) for c in slots])
    short = sum((F.greatest(F.lit(n) - F.col(c), F.lit(0)) for c, n in slots.items()), F.lit(0))
    spare = sum((F.greatest(F.col(c) - F.lit(slots[c]), F.lit(0)) for c in flex), F.lit(0))
    return per.withColumn("short", short).withColumn("flex_short", F.greatest(F.lit(flex_slots) - spare, F.lit(0))).withColumn("legal", (F.col("short") == 0) & (F.col("flex_short") == 0))
