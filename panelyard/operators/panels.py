"""As-of joins, windows and aggregates over (entity, period) panels.

Periods are any orderable column. "Before" is strict unless said otherwise:
a feature of a period reads earlier periods only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators.scratch import settled

Keys = Sequence[str]


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys over the session's shuffle partitions, which Spark does not merge.

    Adaptive execution merges partitions up to a size after compression, so that
    sorts and groups of a task can hold many times that. Joins and groups that
    hold all ``keys`` need no other shuffle and stay within a partition's share.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def asof_join(left: DataFrame, right: DataFrame, by: Keys, on: str, values: Keys, strict: bool = True, suffix: str = "") -> DataFrame:
    """``left`` with the ``values`` of the latest row of ``right`` before (``strict``) or at its ``on``.

    Both sides go through one shuffle on ``by`` and one sort: they are laid in
    one column and the last row of the right side is carried along. A right row
    with a null value counts; where none comes before, values are null. Left
    rows with a null ``on`` get nulls. Of right rows that tie, the one whose
    values are greatest is the last.
    """
    side = F.lit(0 if strict else 1)
    names = list(left.columns)
    a = left.select(*by, F.col(on).alias("__on"), side.alias("__side"), F.struct(*names).alias("__row"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__val"))
    b = right.where(F.col(on).isNotNull()).select(*by, F.col(on).alias("__on"), F.lit(0 if not strict else 1).alias("__side"), F.lit(None).cast(left.select(F.struct(*names)).schema[0].dataType).alias("__row"), F.struct(*values).alias("__val"))
    w = Window.partitionBy(*by).orderBy("__on", "__side", "__val").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("__last", F.last("__val", ignorenulls=True).over(w)).where("__row IS NOT NULL")
    keep = F.col("__on").isNotNull()
    return out.select("__row.*", *[F.when(keep, F.col(f"__last.{v}")).alias(v + suffix) for v in values])


def as_of_sums(facts: DataFrame, by: Keys, on: str, cols: Keys, last: int = 3) -> DataFrame:
    """Adds, for each column, its sum over all earlier rows (``_std``) and the last ``last`` (``_l3``), and ``games`` before."""
    w = Window.partitionBy(*by).orderBy(on)
    past, recent = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(-last, -1)
    return facts.withColumns({"games": F.count(F.lit(1)).over(past), **{f"{c}_std": F.sum(c).over(past) for c in cols}, **{f"{c}_l{last}": F.sum(c).over(recent) for c in cols}})


def last_n_mean(facts: DataFrame, by: Keys, on: str, cols: Keys, n: int = 3) -> DataFrame:
    """One row an entity: the means of its last ``n`` rows."""
    w = Window.partitionBy(*by).orderBy(F.desc(on))
    top = facts.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n)
    return top.groupBy(*by).agg(F.count(F.lit(1)).alias("rows_used"), *[(F.sum(c) / F.count(c)).alias(f"{c}_mean") for c in cols])


def trailing_sum(facts: DataFrame, by: Keys, on: str, col: str, width: int) -> Column:
    """Sum over periods (t - width, t], gaps in periods included."""
    return F.sum(col).over(Window.partitionBy(*by).orderBy(on).rangeBetween(-(width - 1), 0))


def ewm_mean(facts: DataFrame, by: Keys, on: str, col: str, half_life: float = 1.0) -> DataFrame:
    """One row an entity: the mean with weight 1 on its last value, halved every ``half_life`` values before; nulls are passed over."""
    later = Window.partitionBy(*by).orderBy(on).rowsBetween(1, Window.unboundedFollowing)
    known = facts.where(F.col(col).isNotNull()).withColumn("__w", F.pow(F.lit(0.5), F.count(col).over(later) / half_life))
    return known.groupBy(*by).agg((F.sum(F.col(col) * F.col("__w")) / F.sum("__w")).alias(f"{col}_ewm"))


def jump(by: Keys, on: str, col: str, n: int = 3) -> Column:
    """A row's value minus the mean of the ``n`` rows before it."""
    before = Window.partitionBy(*by).orderBy(on).rowsBetween(-n, -1)
    return F.col(col) - F.sum(col).over(before) / F.count(col).over(before)


def share_of_group(by: Keys, col: str) -> Column:
    """A row's share of its group's total, null where that is not positive."""
    total = F.sum(col).over(Window.partitionBy(*by))
    return F.when(total > 0, F.col(col) / total)


def latest_period(facts: DataFrame, by: Keys, on: str) -> DataFrame:
    """Rows of each group's latest period."""
    return facts.withColumn("__m", F.max(on).over(Window.partitionBy(*by))).where(F.col(on) == F.col("__m")).drop("__m")


def role_label(by: Keys, measure: str, tie: str, name: str) -> Column:
    """A label such as WR1: the category and the rank of the measure within the group."""
    return F.concat(F.col(name), F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(measure), tie)).cast("string"))


def qualified_rank(by: Keys, measure: str, count: str, least: int) -> Column:
    """Rank of the measure among rows with at least ``least``; null for others."""
    ok = F.col(count) >= least
    return F.when(ok, F.rank().over(Window.partitionBy(*by, ok).orderBy(F.desc(measure))))


def islands(facts: DataFrame, by: Keys, on: str) -> DataFrame:
    """Runs of consecutive periods: first, last and length."""
    w = Window.partitionBy(*by).orderBy(on)
    runs = facts.select(*by, on).distinct().withColumn("__run", F.col(on) - F.row_number().over(w))
    return runs.groupBy(*by, "__run").agg(F.min(on).alias("first_period"), F.max(on).alias("last_period"), F.count(F.lit(1)).alias("length")).drop("__run")


def league_to_date(facts: DataFrame, on: str, cols: Keys, by: Keys = ()) -> DataFrame:
    """One row a period: totals over all entities of earlier periods. Only period totals are windowed."""
    per = facts.groupBy(*by, on).agg(*[F.sum(c).alias(c) for c in cols])
    w = Window.partitionBy(*by).orderBy(on).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*by, on, *[F.sum(c).over(w).alias(f"{c}_lg") for c in cols])


def running_median(by: Keys, on: str, col: str, half: int = 7, least: int = 5) -> Column:
    """Median over the rows around, null where fewer than ``least``."""
    w = Window.partitionBy(*by).orderBy(on).rowsBetween(-half, half)
    return F.when(F.count(col).over(w) >= least, F.percentile(col, F.lit(0.5)).over(w))


def monotone_curve(facts: DataFrame, by: Keys, on: str, col: str) -> DataFrame:
    """Mean of three neighbours, then never rising: a rank-to-value curve."""
    w = Window.partitionBy(*by).orderBy(on)
    smooth = facts.withColumn("smooth", F.sum(col).over(w.rowsBetween(-1, 1)) / F.count(col).over(w.rowsBetween(-1, 1)))
    return smooth.withColumn("curve", F.min("smooth").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def interpolate(points: DataFrame, curve: DataFrame, by: Keys, x: str, y: str, at: str) -> DataFrame:
    """``points`` with the curve's value at ``at``, linear between its knots and flat beyond the ends."""
    w = Window.partitionBy(*by).orderBy(x)
    steps = curve.select(*by, F.col(x).cast("double").alias("x0"), F.col(y).cast("double").alias("y0"), F.lead(x).over(w).cast("double").alias("x1"), F.lead(y).over(w).cast("double").alias("y1"))
    got = asof_join(points.withColumn("__x", F.col(at).cast("double")), steps.withColumn("__x", F.col("x0")), by, "__x", ["x0", "y0", "x1", "y1"], strict=False)
    first = curve.groupBy(*by).agg(F.min_by(y, x).cast("double").alias("__first"))
    value = F.when(F.col("x0").isNull(), F.col("__first")).when(F.col("x1").isNull(), F.col("y0")).otherwise(F.col("y0") + (F.col("__x") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")))
    return got.join(first, list(by), "left").withColumn("interpolated", value).drop("__x", "x0", "y0", "x1", "y1", "__first")


def open_close(quotes: DataFrame, by: Keys, ts: str, value: str, cutoff: Column) -> DataFrame:
    """First and last value at or before the cutoff, and how many came after."""
    early = F.when(F.col(ts) <= cutoff, F.col(ts))
    return quotes.groupBy(*by).agg(F.min_by(value, early).alias("open"), F.max_by(value, early).alias("close"), F.count(early).alias("quotes"), F.count_if(F.col(ts) > cutoff).alias("after"))


def ever_before(by: Keys, on: str, flag: str) -> Column:
    """Whether the flag was set in an earlier row."""
    return F.coalesce(F.max(F.col(flag).cast("int")).over(Window.partitionBy(*by).orderBy(on).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1


def regulars(facts: DataFrame, entity: str, group: str, on: str, share: str, games: int = 3, least: float = 0.5) -> DataFrame:
    """Entities whose mean share over their group's last ``games`` periods before each period is at least ``least``.

    Periods are numbered within each group; an entity's rows stand for the
    ``games`` numbers after them, so no range join is needed.
    """
    calendar = facts.select(group, on).distinct().withColumn("__g", F.row_number().over(Window.partitionBy(group).orderBy(on)))
    rows = facts.join(calendar, [group, on]).select(entity, group, share, F.explode(F.transform(F.sequence(F.lit(1), F.lit(games)), lambda k: F.col("__g") + k)).alias("__g"))
    mean = rows.groupBy(entity, group, "__g").agg((F.sum(share) / games).alias("share_before"))
    return mean.where(F.col("share_before") >= least).join(calendar, [group, "__g"]).drop("__g")


def periods_between(facts: DataFrame, group: str, on: str) -> DataFrame:
    """The running number of each group's periods: the difference of two is the periods between."""
    return facts.select(group, on).distinct().withColumn("number", F.row_number().over(Window.partitionBy(group).orderBy(on)))


def first_appearance(facts: DataFrame, entity: str, season: str, on: str) -> DataFrame:
    """Each entity's first row of a season."""
    return facts.withColumn("__k", F.row_number().over(Window.partitionBy(entity, season).orderBy(on))).where("__k = 1").drop("__k")


def validity_intervals(facts: DataFrame, by: Keys, on: str, holder: str) -> DataFrame:
    """First and last period of each unbroken holding, and where the next holder's begins."""
    w = Window.partitionBy(*by).orderBy(on)
    runs = facts.withColumn("__change", (~F.col(holder).eqNullSafe(F.lag(holder).over(w))).cast("int")).withColumn("__run", F.sum("__change").over(w))
    out = runs.groupBy(*by, "__run", holder).agg(F.min(on).alias("period_from"), F.max(on).alias("last_seen"))
    return out.withColumn("period_to", F.coalesce(F.lead("period_from").over(Window.partitionBy(*by).orderBy("__run")) - 1, F.col("last_seen"))).drop("__run", "last_seen")


def season_to_date(facts: DataFrame, by: Keys, on: str, through: Column, sums: Keys, labels: Keys = ()) -> DataFrame:
    """One row an entity through a period: last labels, distinct periods, sums and per-period means."""
    past = facts.where(F.col(on) <= through)
    return past.groupBy(*by).agg(F.countDistinct(on).alias("periods"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(on))).alias(c) for c in labels], *[F.sum(c).alias(f"{c}_sum") for c in sums], *[(F.sum(c) / F.countDistinct(on)).alias(f"{c}_rate") for c in sums])


def allowed_to_category(facts: DataFrame, opponent: str, category: str, on: str, col: str) -> DataFrame:
    """Mean per period that each opponent allows a category, less the mean over opponents."""
    per = facts.groupBy(opponent, category, on).agg(F.sum(col).alias("__x"))
    own = per.groupBy(opponent, category).agg(F.sum("__x").alias("__s"), F.count("__x").alias("__n"))
    w = Window.partitionBy(category)
    return own.select(opponent, category, (F.col("__s") / F.col("__n")).alias("allowed"), (F.col("__s") / F.col("__n") - F.sum("__s").over(w) / F.sum("__n").over(w)).alias("relative"))


def proven_off_periods(games: DataFrame, group: str, on: str, expected: int, last: int) -> DataFrame:
    """Periods without a game, only for groups whose games prove it: exactly ``expected`` rows in as many periods."""
    got = games.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(on).alias("d"), F.collect_set(on).alias("seen"))
    off = F.array_sort(F.array_except(F.sequence(F.lit(1), F.lit(last)), F.transform("seen", lambda x: x.cast("int"))))
    proven = (F.col("n") == expected) & (F.col("d") == expected)
    return got.select(group, proven.alias("proven"), F.when(proven, off).alias("off_periods"))


def top_share(facts: DataFrame, by: Keys, member: str, col: str, least: int) -> DataFrame:
    """The largest member's share of each group, for groups with a total of at least ``least``."""
    per = facts.groupBy(*by, member).agg(F.sum(col).alias("__x"))
    return per.groupBy(*by).agg(F.max("__x").alias("top"), F.sum("__x").alias("total")).where(F.col("total") >= least).withColumn("top_share", F.col("top") / F.col("total"))


def who_had_most(facts: DataFrame, by: Keys, member: str, col: str) -> DataFrame:
    """The member with the largest sum; ties go to the smaller id."""
    per = facts.groupBy(*by, member).agg(F.sum(col).alias("most"))
    return per.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("most"), member))).where("__k = 1").drop("__k")


def pooled_mean(rows: DataFrame, by: Keys, value: str, weight: str) -> DataFrame:
    """Mean of per-period values weighted by their counts."""
    return rows.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(f"{value}_pooled"), F.sum(weight).alias("weight"))


def coverage(df: DataFrame, by: Keys, cols: Keys) -> DataFrame:
    """Share of non-null values of each column by group, one row each."""
    wide = df.groupBy(*by).agg(*[(F.count(c) / F.count(F.lit(1))).alias(c) for c in cols])
    return wide.unpivot(list(by), list(cols), "column_name", "coverage")


def top_k(df: DataFrame, by: Keys, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; the order must be total."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def latest_by_key(df: DataFrame, keys: Keys, stamp: Sequence[Column]) -> DataFrame:
    """The newest row of each key."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*stamp))).where("__k = 1").drop("__k")


def replacement_level(df: DataFrame, category: str, value: str, entity: str, starters: dict[str, int], flex: Keys, flex_slots: int) -> DataFrame:
    """The best value left in each category after dedicated and flexible starters are filled, and each row's value over it.

    Two passes of ranks: by category for dedicated places, then among what is
    left of the flexible categories. Only rows within the cut take part in the
    second pass, so its one window holds at most the rows that could start.
    """
    need = F.coalesce(*[F.when(F.col(category) == k, F.lit(n)) for k, n in starters.items()], F.lit(0))
    ranked = ranks(df, [category], -F.col(value), "cat_rank", [entity]).withColumn("need", need)
    pool = ranked.where((F.col("cat_rank") > F.col("need")) & (F.col("cat_rank") <= F.col("need") + flex_slots) & F.col(category).isin(*flex))
    flexed = pool.orderBy(F.desc(value), entity).limit(flex_slots).groupBy(category).agg(F.count(F.lit(1)).alias("flexed"))
    left = ranked.join(flexed, category, "left").withColumn("starts", F.col("cat_rank") <= F.col("need") + F.coalesce("flexed", F.lit(0)))
    level = left.where(~F.col("starts")).groupBy(category).agg(F.max(value).alias("replacement"))
    return left.join(level, category, "left").withColumn("over_replacement", F.col(value) - F.col("replacement")).drop("need", "flexed")


# ---- orders within groups that may be large


def ranged(rows: DataFrame, by: Keys, order: Column, chunks: int = 64) -> DataFrame:
    """Adds ``__o`` (the order) and ``__chunk``: ranges of like row count of each group, in order.

    Equal values share a range. The cuts are one short array a group. They hang
    on the order in which partial results meet, so they are made once and kept:
    whoever reads the rows twice must find them in the same ranges.
    """
    rows = rows.withColumn("__o", order)
    cuts = settled(rows.groupBy(*by).agg(F.percentile_approx("__o", [k / chunks for k in range(1, chunks)], 10_000).alias("__cuts")), "cuts")
    return rows.join(cuts, list(by), "left").withColumn("__chunk", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__o"))), F.lit(0))).drop("__cuts")


def running_sums(rows: DataFrame, by: Keys, order: Column, tie: Keys, sums: Mapping[str, Column]) -> DataFrame:
    """Sums over the rows before each one of its group, in ascending order of ``order`` and ``tie``.

    A window in each range of a group, plus the totals of the ranges before it:
    no group is one task's, however large.
    """
    r = ranged(rows.withColumns({f"__v_{k}": v for k, v in sums.items()}), by, order)
    inside = Window.partitionBy(*by, "__chunk").orderBy("__o", *tie).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)  # rows: the ranges of a group
    totals = r.groupBy(*by, "__chunk").agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums])
    totals = totals.select(*by, "__chunk", *[F.sum(f"__t_{k}").over(before).alias(f"__b_{k}") for k in sums])
    r = r.withColumns({k: F.sum(f"__v_{k}").over(inside) for k in sums}).join(totals, [*by, "__chunk"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return r.withColumns({k: zero(k) + zero(f"__b_{k}") for k in sums}).drop("__o", "__chunk", *[f"__{x}_{k}" for k in sums for x in "vb"])


def ranks(rows: DataFrame, by: Keys, order: Column, name: str, tie: Keys = ()) -> DataFrame:
    """The rank of each row in its group, ascending: with ``tie`` every row its own, without equal values one."""
    r = ranged(rows, by, order)
    w = Window.partitionBy(*by, "__chunk").orderBy("__o", *tie)
    before = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)  # rows: the ranges of a group
    totals = r.groupBy(*by, "__chunk").agg(F.count(F.lit(1)).alias("__rank_total"))
    totals = totals.select(*by, "__chunk", F.coalesce(F.sum("__rank_total").over(before), F.lit(0)).alias("__rank_before"))
    own = F.row_number().over(w) if tie else F.rank().over(w)
    return r.withColumn(name, own).join(totals, [*by, "__chunk"]).withColumn(name, F.col(name) + F.col("__rank_before")).drop("__o", "__chunk", "__rank_before")
