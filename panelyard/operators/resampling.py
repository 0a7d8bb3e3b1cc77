"""Intervals by resampling with hashed weights: every replicate is a sum over the same rows, and reruns agree."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.operators.ordered import ordered_pairs

#: How often a row stands in a resample as large as the sample: shares of a Poisson number of mean 1 that are at most 0, 1, 2 and so on.
_UP_TO = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, k + 1)) for k in range(12)])
#: The same as whole numbers: 52 bits are under one just when they are, as a share of 2**52, under the other.
_BITS_UP_TO = [math.ceil(float(c) * 2**52) for c in _UP_TO]


def _hashed(replicate: Column, *key: Column, salt: str = "") -> Column:
    """The last 52 bits of a hash of a replicate and a key."""
    return F.xxhash64(F.lit(salt), replicate, *key).bitwiseAND(F.lit(2**52 - 1))


def _poisson(bits: Column) -> Column:
    """The Poisson number of mean 1 that 52 bits draw. It names them a dozen times, so over many rows they should be a column by then."""
    # The first share that is not passed ends the search.
    drawn = F.when(bits < _BITS_UP_TO[0], 0)
    for k, c in enumerate(_BITS_UP_TO[1:], 1):
        drawn = drawn.when(bits < c, k)
    return drawn.otherwise(len(_BITS_UP_TO))


def times(replicate: Column, *key: Column, salt: str = "") -> Column:
    """How often a key stands in a replicate: a Poisson number of mean 1, drawn by a hash of both, so that it is the same wherever it is asked for."""
    return _poisson(_hashed(replicate, *key, salt=salt))


def _replicates(sums: DataFrame, reps: int) -> DataFrame:
    """Every row once for each replicate; 0 is the sample as it is."""
    return sums.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps))))


def two_level_interval(rows: DataFrame, by: Sequence[str], group: Sequence[str], member: Sequence[str], numerator: Column, denominator: Column | None = None, reps: int = 400, level: float = 0.9, salt: str = "two") -> DataFrame:
    """A mean (or ratio of sums) of every ``by`` with an interval from resampling groups, members within groups, and rows.

    A row counts as often as its group, its member within the group and itself
    were drawn together; members of a group that is drawn twice count twice, as
    in a resample of whole groups followed by one of what they hold. Rows with
    a null numerator or denominator are left out, and a null key is a key of its
    own. Returns ``by``, ``n``, ``estimate``, ``low``, ``high``, ``below_zero`` (share
    of replicates) and ``reps``, those with a denominator.

    A row's three draws are made where it lies and its weighed numbers summed by
    ``by`` and replicate at once, so what moves is a few sums a replicate and
    neither rows nor members.
    """
    key, inner = list(by), [*by, *group, *member]
    base = rows.select(*[F.col(c) for c in dict.fromkeys(inner)], numerator.cast("double").alias("x"), (denominator if denominator is not None else F.lit(1.0)).cast("double").alias("d")).where("x IS NOT NULL AND d IS NOT NULL")
    # A row is told by its values, so that any order of rows makes the same draws: equal rows of a member are drawn together.
    # Rows are few megabytes before they are repeated, and would be one task's.
    spread = base.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    repeated = _replicates(spread.withColumn("own", F.xxhash64("x", "d")), reps)
    levels = {"g": [*key, *group], "m": inner, "r": [*inner, "own"]}
    # Each draw's hash is a column: written out at every share of three draws, it makes a method over the 8,000 bytes that the JVM compiles.
    hashed = repeated.select(*key, "rep", "x", "d", *[_hashed(F.col("rep"), *[F.col(c) for c in cols], salt=salt + level).alias(f"__{level}") for level, cols in levels.items()])
    # A row that a replicate does not draw adds nothing to its sums; where its group is not drawn, its other hashes are not worked out.
    whole, g, m, r = F.col("rep") == 0, *[F.col(f"__{level}") for level in levels]
    drawn = hashed.where(whole | ((g >= _BITS_UP_TO[0]) & (m >= _BITS_UP_TO[0]) & (r >= _BITS_UP_TO[0])))
    weighed = drawn.withColumn("w", F.when(whole, 1).otherwise(_poisson(g) * _poisson(m) * _poisson(r)))
    per = weighed.groupBy(*key, "rep").agg(F.sum(F.col("w") * F.col("x")).alias("x"), F.sum(F.col("w") * F.col("d")).alias("d"), F.count(F.lit(1)).alias("n"))
    return interval(per.withColumn("value", F.try_divide("x", "d")), key, level)


def interval(per: DataFrame, by: Sequence[str], level: float = 0.9) -> DataFrame:
    """Of one ``value`` a replicate (rep 0: the sample's own, with ``n``): the estimate and the replicates' quantiles."""
    low, high = (1 - level) / 2, (1 + level) / 2
    again = F.when(F.col("rep") > 0, F.col("value"))
    return per.groupBy(*by).agg(F.max(F.when(F.col("rep") == 0, F.col("n"))).cast("long").alias("n"), F.max(F.when(F.col("rep") == 0, F.col("value"))).alias("estimate"), F.percentile(again, F.lit(low)).alias("low"), F.percentile(again, F.lit(high)).alias("high"), F.avg((again < 0).cast("double")).alias("below_zero"), F.count(again).alias("reps"))


def _drawn(rows: DataFrame, key: Sequence[Column], reps: int, salt: str) -> DataFrame:
    """Rows with ``draws``: a byte for each replicate, as ``times`` draws it; the first, 1, is the sample as it is."""
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)
    hashed = rows.withColumn("draws", F.array(*[F.xxhash64(F.lit(salt), F.lit(r), *key) for r in range(1, reps + 1)]).cast("array<long>"))

    def draw(batches):
        for batch in batches:
            h = batch.column("draws").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, reps)
            w = np.ones((batch.num_rows, reps + 1), np.uint8)
            w[:, 1:] = np.searchsorted(_UP_TO, (h & (2**52 - 1)) / float(2**52), side="right")
            at = batch.schema.get_field_index("draws")
            yield batch.set_column(at, "draws", pa.array([x.tobytes() for x in w], pa.binary()))

    return hashed.mapInArrow(draw, kinds + ", draws binary")


def pairwise_interval(rows: DataFrame, by: Sequence[str], group: Sequence[str], member: str, systems: tuple[str, str], actual: str, reps: int = 200, level: float = 0.9, block: int = 8192, salt: str = "pairs") -> DataFrame:
    """Share of rightly ordered pairs of the first system less that of the second, with an interval from resampling members within every group.

    Pairs are made anew in every replicate: two members drawn a and b times make
    a x b pairs, and one drawn twice makes none with itself, as both have one
    outcome. Pairs of equal outcomes count nothing, a tie of a system is a miss.
    All replicates are counted in one pass by ``ordered_pairs``, which forms no
    pair and cuts groups into ranges of about ``block`` rows; pairs of two rows
    of one member are taken off.
    Returns ``by``, ``n`` (pairs), ``estimate``, ``low``, ``high``, ``below_zero``,
    ``reps``. Rows with a null are left out.
    """
    key, whole = list(by), list(dict.fromkeys([*by, *group]))
    known = rows.select(*whole, F.col(member).alias("m"), *[F.col(c).cast("double").alias(f"s{i}") for i, c in enumerate(systems)], F.col(actual).cast("double").alias("y")).dropna(subset=["s0", "s1", "y"])
    drawn = _drawn(known, [*[F.col(c) for c in whole], F.col("m")], reps, salt)
    found = ordered_pairs(drawn, whole, ["s0", "s1"], "y", draws="draws", reps=reps + 1, block=block)
    again = known.groupBy(*whole, "m").agg(F.count(F.lit(1)).alias("again")).where("again > 1").drop("again")
    repeated = drawn.alias("a").join(again.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*whole, "m")], "left_semi")
    own = ordered_pairs(repeated, [*whole, "m"], ["s0", "s1"], "y", draws="draws", reps=reps + 1, block=block)
    both = found.select(*key, "system", "rep", "pairs", "right").unionByName(own.select(*key, "system", "rep", (-F.col("pairs")).alias("pairs"), (-F.col("right")).alias("right")))
    of = lambda c, s: F.sum(F.when(F.col("system") == s, F.col(c)))
    per = both.groupBy(*key, "rep").agg(of("pairs", 0).alias("n"), of("right", 0).alias("a"), of("right", 1).alias("b"))
    return interval(per.withColumn("value", F.try_divide((F.col("a") - F.col("b")).cast("double"), F.col("n").cast("double"))), key, level)


def grid_interval(rows: DataFrame, cluster: Sequence[str], fit: Column, losses: Mapping[float, Column], plain: float, reps: int = 400, level: float = 0.95, salt: str = "grid") -> DataFrame:
    """The grid value with the least mean loss on the fitting rows, and what it gains on the others over ``plain``, with intervals from resampling clusters.

    ``losses`` gives every grid value's loss of a row; ``fit`` tells fitting rows
    from test rows. Rows are summed once, by cluster and side, for all grid
    values; every replicate draws clusters of either side, chooses its own grid
    value from the fitting side (the smaller on a tie) and judges that on the
    test side. Returns one row: ``n_fit``, ``n_test``, ``value``, ``value_low``,
    ``value_high``, ``gain``, ``gain_low``, ``gain_high``, ``share_better``,
    ``reps``. Rows with a null loss are left out; without a row on either side
    the numbers are null.
    """
    grid = sorted(losses)
    side = F.when(F.coalesce(fit, F.lit(False)), "fit").otherwise("test")
    rows = rows.select(*cluster, side.alias("side"), *[losses[g].cast("double").alias(f"l{i}") for i, g in enumerate(grid)]).dropna(subset=[f"l{i}" for i in range(len(grid))])
    sums = rows.groupBy(*cluster, "side").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"l{i}").alias(f"l{i}") for i in range(len(grid))])
    drawn = _replicates(sums, reps).withColumn("w", F.when(F.col("rep") == 0, 1).otherwise(times(F.col("rep"), "side", *[F.col(c) for c in cluster], salt=salt)))
    of = lambda c, s: F.sum(F.when(F.col("side") == s, F.col("w") * F.col(c)))
    per = drawn.groupBy("rep").agg(of("n", "fit").alias("nf"), of("n", "test").alias("nt"), *[of(f"l{i}", "fit").alias(f"f{i}") for i in range(len(grid))], *[of(f"l{i}", "test").alias(f"t{i}") for i in range(len(grid))])
    choices = F.array(*[F.struct(F.try_divide(f"f{i}", "nf").alias("loss"), F.lit(float(g)).alias("value"), F.try_divide(f"t{i}", "nt").alias("held")) for i, g in enumerate(grid)])
    best = F.when((F.col("nf") > 0) & (F.col("nt") > 0), F.array_min(choices))
    per = per.select("rep", "nf", "nt", best.alias("b"), F.try_divide(f"t{grid.index(plain)}", "nt").alias("plain")).withColumn("gain", F.col("plain") - F.col("b.held")).withColumn("value", F.col("b.value"))
    first = lambda c: F.max(F.when(F.col("rep") == 0, F.col(c)))
    at = lambda c, q: F.percentile(F.when(F.col("rep") > 0, F.col(c)), F.lit(q))
    low, high = (1 - level) / 2, (1 + level) / 2
    return per.agg(first("nf").cast("long").alias("n_fit"), first("nt").cast("long").alias("n_test"), first("value").alias("value"), at("value", low).alias("value_low"), at("value", high).alias("value_high"), first("gain").alias("gain"), at("gain", low).alias("gain_low"), at("gain", high).alias("gain_high"), F.avg(F.when(F.col("rep") > 0, (F.col("gain") > 0).cast("double"))).alias("share_better"), F.count_if((F.col("rep") > 0) & F.col("value").isNotNull()).alias("reps"))
