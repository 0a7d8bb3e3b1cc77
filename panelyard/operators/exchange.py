"""Lineups with rows that may not move, and what every addition and drop would gain, by exchange along the slots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def locked_lineup(rows: DataFrame, roster: Sequence[str], category: str, value: str, entity: str, slots: Mapping[str, int], flex: Sequence[str], flex_slots: int, current: str, movable: str) -> DataFrame:
    """Each roster's best lineup that can be reached from its current one: adds ``slot`` (category, FLEX or null) and ``fixed``.

    A starter of the ``current`` slots who is not ``movable`` (null counts as
    not), or has no value, stays in his slot and is ``fixed``; a bench row of
    that kind never starts. What is left of each kind of slot is filled from the
    others by value, dedicated slots first, then the flexible ones from what is
    left; that is best, as every row of a flexible category fits every flexible
    slot. Ties go to the smaller entity. A current slot of no known kind counts
    as bench.
    """
    known = [*slots, "FLEX"]
    free = F.coalesce(F.col(movable), F.lit(False)) & F.col(value).isNotNull()
    rows = rows.withColumn("fixed", F.coalesce(F.col(current).isin(*known), F.lit(False)) & ~free)
    whole = Window.partitionBy(*roster)
    taken = lambda slot: F.count_if(F.col("fixed") & (F.col(current) == slot)).over(whole)
    need = F.coalesce(*[F.when(F.col(category) == c, F.lit(n) - taken(c)) for c, n in slots.items()], F.lit(0))
    rows = rows.withColumn("__need", need).withColumn("__places", F.lit(flex_slots) - taken("FLEX")).withColumn("__in", free & ~F.col("fixed"))
    order = [F.col(value).desc_nulls_last(), F.col(entity)]
    k = F.row_number().over(Window.partitionBy(*roster, category, "__in").orderBy(*order))
    rows = rows.withColumn("__own", F.col("__in") & (k <= F.col("__need")))
    can = F.col("__in") & ~F.col("__own") & F.col(category).isin(*flex)
    rows = rows.withColumn("__can", F.coalesce(can, F.lit(False)))
    j = F.row_number().over(Window.partitionBy(*roster, "__can").orderBy(*order))
    slot = F.when(F.col("fixed"), F.col(current)).when(F.col("__own"), F.col(category)).when(F.col("__can") & (j <= F.col("__places")), "FLEX")
    return rows.withColumn("slot", slot).drop("__need", "__places", "__in", "__own", "__can")


def exchanges(rows: DataFrame, roster: Sequence[str], category: str, value: str, entity: str, slots: Mapping[str, int], flex: Sequence[str], flex_slots: int, current: str, movable: str, droppable: Column, cheapest_bench: bool = False) -> DataFrame:
    """For each roster, category and droppable row (and none): what its drop costs, and what an addition of that category must beat.

    ``roster``, ``category``, ``drop``, ``drop_value``, ``cost`` (the lineup's
    points without the row less those with it, 0 or below where values are
    positive), ``open`` (a slot that an addition reaches is empty) and ``beats``
    (value, entity of the starter whom it would put out; null if none). An
    addition reaches the slots of its category and, if that is a flexible one,
    the flexible slots: whoever leaves a dedicated slot has been the least there,
    so a longer way through other categories never frees a lesser starter.

    Only the drop of a starter changes a lineup, so it is filled anew once for
    each slot at most, whatever the length of the roster; all bench rows share
    the roster's own. With fixed rows the same holds, as these neither move nor
    are put out. ``droppable`` is a condition on ``rows``; fixed rows are never
    dropped.

    Lineups are filled from fixed rows and the first rows of each category alone:
    no row can start that has as many before it as there are slots for its
    category and one more, the dropped one. ``cheapest_bench`` returns of each
    roster's bench the drop of least value alone, the smaller entity on a tie;
    it stands for all in ``add_drop_gains``.
    """
    args = (category, value, entity, slots, flex, flex_slots, current, movable)
    key = list(roster)
    free = F.coalesce(F.col(movable), F.lit(False)) & F.col(value).isNotNull()
    stuck = F.coalesce(F.col(current).isin(*slots, "FLEX"), F.lit(False)) & ~free
    first = F.row_number().over(Window.partitionBy(*key, category, "__free").orderBy(F.col(value).desc_nulls_last(), entity))
    # Rows that are neither free nor fixed count for nothing; the first of them keep a roster of such rows.
    ahead = rows.where(~stuck).withColumn("__free", free).withColumn("__k", first).where(F.col("__k") <= max(slots.values(), default=0) + flex_slots + 1)
    few = rows.where(stuck).unionByName(ahead.drop("__free", "__k"))
    may = F.coalesce(droppable, F.lit(False)) & ~stuck
    starters = locked_lineup(few, key, *args).where(may & F.col("slot").isNotNull()).select(*key, F.col(entity).alias("__drop"), F.col(value).alias("drop_value"))
    trials = starters.drop("drop_value").unionByName(few.select(*key).distinct().withColumn("__drop", F.lit(None).cast(dict(rows.dtypes)[entity])))
    # A dropped row stays without value, slot and leave to move, so that a roster of one is still there.
    out = F.col("__drop").isNotNull() & (F.col(entity) == F.col("__drop"))
    gone = {value: F.when(~out, F.col(value)), current: F.when(~out, F.col(current)), movable: F.when(~out, F.col(movable))}
    trial = few.join(trials, key).withColumn("__n", F.coalesce(F.xxhash64("__drop"), F.lit(0))).withColumns(gone)
    lineups = locked_lineup(trial, [*key, "__drop", "__n"], *args)
    held_free = F.col("slot").isNotNull() & ~F.col("fixed")
    least = lambda c: F.min(F.when(held_free & (F.col("slot") == c), F.struct(F.col(value).alias("value"), F.col(entity).alias("entity"))))
    held = lambda c: F.count_if(F.col("slot") == c)
    kinds = [*slots, "FLEX"]
    sums = lineups.groupBy(*key, "__drop").agg(F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col(value))), F.lit(0)).alias("__points"), *[least(c).alias(f"__least_{k}") for k, c in enumerate(kinds)], *[held(c).alias(f"__held_{k}") for k, c in enumerate(kinds)])
    places = {**slots, "FLEX": flex_slots}

    def way(c: str) -> Column:
        reach = [k for k, kind in enumerate(kinds) if kind == c or kind == "FLEX" and c in flex]
        empty = reduce(Column.__or__, [F.col(f"__held_{k}") < places[kinds[k]] for k in reach], F.lit(False))
        beaten = [F.col(f"__least_{k}") for k in reach]
        nobody = F.lit(None).cast(sums.schema["__least_0"].dataType)
        return F.struct(F.lit(c).alias(category), empty.alias("open"), (F.least(*beaten) if len(beaten) > 1 else beaten[0] if beaten else nobody).alias("beats"))

    every = [*dict.fromkeys([*slots, *flex])]
    own = sums.select(*key, "__drop", "__points", F.explode(F.array(*[way(c) for c in every])).alias("w")).select(*key, "__drop", "__points", "w.*")
    before = own.where("__drop IS NULL").select(*key, category, F.col("__points").alias("__before"), "open", "beats")
    bench = rows.where(may).select(*key, F.col(entity).alias("__drop"), F.col(value).alias("drop_value")).join(starters, [*key, "__drop"], "left_anti")
    if cheapest_bench:
        bench = bench.groupBy(*key).agg(F.min(F.struct("drop_value", "__drop")).alias("c")).select(*key, "c.__drop", "c.drop_value")
    of_start = own.where("__drop IS NOT NULL").join(before.select(*key, category, "__before"), [*key, category]).join(starters, [*key, "__drop"])
    of_start = of_start.select(*key, category, F.col("__drop").alias("drop"), "drop_value", (F.col("__points") - F.col("__before")).alias("cost"), "open", "beats")
    zero = F.col("__before") - F.col("__before")
    of_bench = before.join(bench, key).select(*key, category, F.col("__drop").alias("drop"), "drop_value", zero.alias("cost"), "open", "beats")
    none = before.select(*key, category, F.lit(None).cast(dict(rows.dtypes)[entity]).alias("drop"), F.lit(None).cast(dict(rows.dtypes)[value]).alias("drop_value"), zero.alias("cost"), "open", "beats")
    return of_start.unionByName(of_bench).unionByName(none)


def gain(value: Column, way: Column) -> Column:
    """What an addition of that value gains along a way of ``exchanges``: an empty slot takes it as it is, a full one only if it beats the least starter."""
    return way["cost"] + F.when(way["open"], value).when(way["beats"].isNull(), value - value).otherwise(F.greatest(value - way["beats"]["value"], value - value))


def exchange_gains(pool: DataFrame, ways: DataFrame, within: Sequence[str], category: str, value: str, entity: str) -> DataFrame:
    """The gain of every addition and drop (null: none) as a row; for small pools, as it has a row for each roster, addition and droppable row."""
    adds = pool.select(*within, category, F.col(entity).alias("add"), F.col(value).alias("__value"))
    way = F.struct("cost", "open", "beats")
    return ways.join(adds, [*within, category]).withColumn("gain", gain(F.col("__value"), way)).drop("__value", "cost", "open", "beats", "drop_value")


def add_drop_gains(pool: DataFrame, ways: DataFrame, roster: Sequence[str], within: Sequence[str], category: str, value: str, entity: str, open_places: DataFrame | None = None) -> DataFrame:
    """The best drop of every roster and free entity: ``add``, ``value``, ``drop``, ``gain`` and ``sits``.

    ``pool`` has the free entities with the columns ``within`` (those of
    ``roster`` that both share); none is left out for its rank. ``ways`` comes
    from ``exchanges``. The gain is that of the whole lineup filled anew. Of
    drops of one gain the cheapest is named, then the smaller entity. Rosters in
    ``open_places`` (``roster`` columns) add without a drop where that gains. A
    roster without a droppable row has null drop and gain. ``sits`` is the
    starter put out, null for an empty slot.

    Ways are gathered into one array for each roster and category before the
    pool is joined, at most one for each slot and one for the bench, so a row
    stands for a roster and addition and never for a drop.
    """
    key = list(roster)
    order = F.struct(F.col("drop_value").alias("v"), F.col("drop").alias("e"))
    drops = ways.where("drop IS NOT NULL")
    # All bench rows share cost and ways: the cheapest of each stands for them.
    per = drops.groupBy(*key, category, "cost", "open", "beats").agg(F.min(order).alias("d"))
    held = per.groupBy(*key, category).agg(F.collect_list(F.struct("cost", "open", "beats", F.col("d.v").alias("v"), F.col("d.e").alias("e"))).alias("ways"))
    none = ways.where("drop IS NULL").select(*key, category, F.struct("cost", "open", "beats").alias("alone"))
    sides = none.join(held, [*key, category], "left")
    sides = sides.join(open_places.select(*key).distinct().withColumn("spare", F.lit(True)), key, "left") if open_places is not None else sides.withColumn("spare", F.lit(False))
    return _judged(pool, sides, key, within, category, value, entity)


def cheapest_of_category(rows: DataFrame, roster: Sequence[str], category: str, value: str, entity: str, droppable: Column) -> DataFrame:
    """The cheapest droppable row of each roster and category, as ``versus``."""
    cheap = F.min(F.struct(F.col(value).alias("v"), F.col(entity).alias("e")))
    return rows.where(F.coalesce(droppable, F.lit(False)) & F.col(value).isNotNull()).groupBy(*roster, category).agg(cheap.alias("versus"))


def _judged(pool: DataFrame, sides: DataFrame, key: list[str], within: Sequence[str], category: str, value: str, entity: str) -> DataFrame:
    adds = pool.where(F.col(value).isNotNull()).select(*within, category, F.col(entity).alias("add"), F.col(value).alias("__value"))
    each = F.transform("ways", lambda w: F.struct(gain(F.col("__value"), w).alias("gain"), (-w["v"]).alias("cheap"), w["e"].alias("drop"), w["beats"].alias("beats"), w["open"].alias("open")))
    best = F.aggregate(F.slice(each, 2, F.greatest(F.size(each) - 1, F.lit(0))), F.get(each, F.lit(0)), lambda a, b: F.when((b["gain"] > a["gain"]) | (b["gain"] == a["gain"]) & ((b["cheap"] > a["cheap"]) | (b["cheap"] == a["cheap"]) & (b["drop"] < a["drop"])), b).otherwise(a))
    rows = sides.join(adds, [*within, category]).withColumn("__alone", gain(F.col("__value"), F.col("alone"))).withColumn("__best", F.when(F.col("ways").isNotNull(), best))
    no_drop = F.coalesce(F.col("spare"), F.lit(False)) & (F.col("__alone") > 0)
    out = rows.select(*key, category, "add", F.col("__value").alias("value"), F.when(~no_drop, F.col("__best.drop")).alias("drop"), F.when(no_drop, F.col("__alone")).otherwise(F.col("__best.gain")).alias("gain"), F.when(no_drop, F.struct(F.col("alone.open").alias("open"), F.col("alone.beats").alias("beats"))).otherwise(F.struct("__best.open", "__best.beats")).alias("__way"))
    sits = F.when((F.col("gain") > 0) & ~F.col("__way.open"), F.col("__way.beats.entity"))
    return out.withColumn("sits", sits).drop("__way")


def verdicts(board: DataFrame, versus: DataFrame, roster: Sequence[str], category: str) -> DataFrame:
    """Adds ``verdict``, ``versus`` and ``gap`` to the rows of ``add_drop_gains``.

    LINEUP where the gain is above 0, else by the cheapest droppable row of the
    category (``versus``): RESEARCH where the addition's value is above his,
    BELOW where it is not, COVERAGE where there is none.
    """
    out = board.join(versus, [*roster, category], "left").withColumn("gap", F.col("value") - F.col("versus.v"))
    verdict = F.when(F.col("gain") > 0, "LINEUP").when(F.col("versus").isNull(), "COVERAGE").when(F.col("gap") > 0, "RESEARCH").otherwise("BELOW")
    return out.withColumn("verdict", verdict).withColumn("versus", F.col("versus.e"))
