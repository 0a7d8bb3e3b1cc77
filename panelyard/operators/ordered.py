"""Rightly ordered pairs of groups of any size, weighed or not: pairs are counted, never formed, and no group is one task's."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.operators.scratch import settled

#: How many ranges a group is cut into at most.
_RANGES = 64
#: Runs of this length are compared whole; longer ones are merged.
_RUN = 64


def before(at: np.ndarray, s: np.ndarray, give: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """For each column of the weights: the sum of give[i] x ask[j] over pairs with at[i] < at[j] and s[i] < s[j]."""
    n, reps = give.shape
    order = np.lexsort((-s, at))  # of one place the greater s is first, so that its pairs never count
    _, s = np.unique(s[order], return_inverse=True)
    give, ask = give[order], ask[order]
    full = -(-n // _RUN) * _RUN
    pad = lambda x, v: np.concatenate([x, np.full((full - n, *x.shape[1:]), v, x.dtype)])
    runs, g, a = pad(s, 0).reshape(-1, _RUN), pad(give, 0).reshape(-1, _RUN, reps), pad(ask, 0).reshape(-1, _RUN, reps)
    hit = (runs[:, :, None] > runs[:, None, :]) & np.tri(_RUN, k=-1, dtype=bool)
    total = np.einsum("kir,kir->r", a, hit.astype(np.float64) @ g)
    perm, width, span = np.arange(n), _RUN, 2 * (int(s.max(initial=0)) + 1)
    while width < n:
        later = (np.arange(n) // width) & 1
        key = (np.arange(n) // (2 * width)) * span + s * 2 + 1 - later  # of equal s the later are first
        perm = perm[np.argsort(key[perm], kind="stable")]
        is_later = later[perm] == 1
        first, last = perm[~is_later], perm[is_later]
        sums = np.concatenate([np.zeros((1, reps)), np.cumsum(give[first], axis=0)])
        earlier = np.concatenate([[0], np.cumsum(~is_later)])
        at_last = np.flatnonzero(is_later)
        own = sums[earlier[at_last]] - sums[earlier[at_last // (2 * width) * (2 * width)]]
        total += np.einsum("ir,ir->r", ask[last], own)
        width *= 2
    return total


def apart(at: np.ndarray, give: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """The sum of give[i] x ask[j] over pairs with at[i] < at[j]."""
    _, place = np.unique(at, return_inverse=True)
    sums = np.zeros((int(place.max(initial=0)) + 2, give.shape[1]))
    np.add.at(sums, place + 1, give)
    return np.einsum("ir,ir->r", ask, np.cumsum(sums, axis=0)[place])


def _weights(table: pa.Table, reps: int) -> tuple[np.ndarray, np.ndarray]:
    """What rows give and ask, by replicate; ``role`` is 0 for a row, 1 for a question, 2 for both."""
    role = table.column("role").to_numpy()
    w = np.frombuffer(b"".join(table.column("draws").to_pylist()), np.uint8).reshape(-1, reps).astype(np.float64) if "draws" in table.column_names else np.ones((len(role), 1))
    return w * (role != 1)[:, None], w * (role != 0)[:, None]


def _place(value: Column, cuts: Column) -> Column:
    """Twice the cuts below a value, and one more at a cut: an odd range holds one value alone, an even one those between two cuts."""
    return F.size(F.filter(cuts, lambda c: c < value)) * 2 + F.array_contains(cuts, value).cast("int")


def ordered_pairs(rows: DataFrame, by: Sequence[str], systems: Sequence[str], actual: str, gap: float = 0.0, draws: str | None = None, reps: int = 1, block: int = 8192) -> DataFrame:
    """For each group and system (``system``, its number) and replicate (``rep``): ``pairs`` whose outcomes differ by more than ``gap``, and how many of them the system puts in their order (``right``).

    ``draws`` is a column of ``reps`` bytes, how often a row stands in each
    replicate; a pair counts as often as the product. Rows hold no nulls.

    A group is cut by the outcome and by each system into ranges of like row
    count (up to 64, of about ``block`` rows where that is enough), in which a frequent value has a range
    of its own. A pair is then of one of three kinds: both in one range of the
    outcome, counted there; in two of these but one range of the system, counted
    there; in two of each, told by the ranges alone, from sums by cell. So a row
    goes to one task for the outcome and to one for each system, whatever the
    size of its group.
    """
    keys, names = list(by), [f"s{i}" for i in range(len(systems))]
    kinds = dict(rows.dtypes)
    both = rows.select(*keys, *[(F.col(s).cast("double") + 0.0).alias(n) for s, n in zip(systems, names, strict=True)], (F.col(actual).cast("double") + 0.0).alias("y"), *([F.col(draws).alias("draws")] if draws else []))
    both = settled(both, "pairs")  # read for the cuts, the outcome and the systems
    if gap:
        both = both.select("*", F.inline(F.array(F.struct(F.col("y").alias("at"), F.lit(0).alias("role")), F.struct((F.col("y") - gap).alias("at"), F.lit(1).alias("role"))))).drop("y")
    else:
        both = both.withColumnRenamed("y", "at").withColumn("role", F.lit(2))
    wide = ["at", *names]
    cuts = both.groupBy(*keys).agg(F.least(F.ceil(F.count(F.lit(1)) / block), F.lit(_RANGES)).cast("int").alias("parts"), *[F.percentile_approx(c, [k / _RANGES for k in range(1, _RANGES)], 10_000).alias(f"c_{c}") for c in wide])
    # Of 63 cuts those that make as many ranges as the group has parts. They hang on the order in which partial results meet, so they are made once.
    cuts = settled(cuts.select(*keys, "parts", *[F.array_distinct(F.filter(f"c_{c}", lambda x, i: F.floor((i + 1) * F.col("parts") / _RANGES) > F.floor(i * F.col("parts") / _RANGES))).alias(f"c_{c}") for c in wide]), "cuts")
    same = [both[k].eqNullSafe(cuts[k]) for k in keys]
    placed = both.join(cuts, same if keys else None, "inner" if keys else "cross").select(*[both[k] for k in keys], "role", "parts", *wide, *[_place(F.col(c), F.col(f"c_{c}")).alias(f"r_{c}") for c in wide], *(["draws"] if draws else []))
    told = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "system int, y_r int, s_r int, a array<double>, b array<double>"])
    head = lambda table, n: {c: pa.array([table.column(c)[0].as_py()] * n, table.schema.field(c).type) for c in keys}

    def answer(table: pa.Table, found: list[tuple]) -> pa.Table:
        cols = list(zip(*found, strict=True)) if found else [[]] * 5
        return pa.table(head(table, len(found)) | {c: pa.array(list(v), t) for c, v, t in zip(("system", "y_r", "s_r", "a", "b"), cols, (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)})

    def by_outcome(table: pa.Table) -> pa.Table:
        """Pairs of one range of the outcome, and the sums of its cells."""
        give, ask = _weights(table, reps)
        y_r, at = table.column("r_at")[0].as_py(), table.column("at").to_numpy()
        found, alone = [], y_r % 2 == 1
        pairs = np.zeros(give.shape[1]) if alone else apart(at, give, ask)
        for k, name in enumerate(names):
            found.append((k, None, None, pairs, pairs * 0 if alone else before(at, table.column(name).to_numpy(), give, ask)))
            if table.column("parts")[0].as_py() > 1:
                ranges, own = np.unique(table.column(f"r_{name}").to_numpy(), return_inverse=True)
                sums = np.zeros((2, len(ranges), give.shape[1]))
                np.add.at(sums[0], own, give)
                np.add.at(sums[1], own, ask)
                found += [(k, y_r, int(r), sums[0, i], sums[1, i]) for i, r in enumerate(ranges)]
        return answer(table, found)

    def by_system(table: pa.Table) -> pa.Table:
        """Pairs of one range of the system in two of the outcome."""
        give, ask = _weights(table, reps)
        right = before(table.column("y_r").to_numpy(), table.column("s").to_numpy(), give, ask)
        return answer(table, [(table.column("system")[0].as_py(), None, None, right * 0, right)])

    def by_cell(table: pa.Table) -> pa.Table:
        """What the ranges of the outcome counted, and the pairs that lie in two ranges of each."""
        a, b = (np.array(table.column(c).to_pylist(), dtype=np.float64) for c in "ab")
        cell = table.column("y_r").is_valid().to_numpy()
        pairs, right = a[~cell].sum(axis=0), b[~cell].sum(axis=0)
        if cell.any():
            y_r, s_r = (np.array(table.column(c).filter(pa.array(cell)).to_pylist()) for c in ("y_r", "s_r"))
            pairs = pairs + apart(y_r, a[cell], b[cell])
            right = right + before(y_r, s_r, a[cell], b[cell])
        return answer(table, [(table.column("system")[0].as_py(), None, None, pairs, right)])

    # A range of one value has no pairs of its own; it may be large, and its sums are made in parts.
    part = F.when(F.col("r_at") % 2 == 1, F.pmod(F.xxhash64(*names), F.lit(_RANGES))).otherwise(0)
    of_outcome = placed.withColumn("part", part).groupBy(*keys, "r_at", "part").applyInArrow(by_outcome, told).groupBy(*keys, "system").applyInArrow(by_cell, told)
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("system"), F.col(n).alias("s"), F.col(f"r_{n}").alias("s_r")) for k, n in enumerate(names)]))
    of_system = placed.where("parts > 1").select(*keys, F.col("r_at").alias("y_r"), "role", *(["draws"] if draws else []), each).where("s_r % 2 = 0").groupBy(*keys, "system", "s_r").applyInArrow(by_system, told)
    sums = of_outcome.unionByName(of_system).select(*keys, "system", F.posexplode(F.arrays_zip(F.col("a").alias("pairs"), F.col("b").alias("right"))).alias("rep", "x"))
    return sums.groupBy(*keys, "system", "rep").agg(F.sum("x.pairs").cast("long").alias("pairs"), F.sum("x.right").cast("long").alias("right"))
