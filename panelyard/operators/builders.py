"""Grids as table functions, and a registry of feature builders that lets no builder in which looks ahead."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from panelyard.operators.features import leak_rows


@udtf(returnType="round int, slot int, pick int")
class PickGrid:
    """Every pick of a draft of so many slots and rounds, in order; rounds turn back where ``snake`` is true. Nulls and counts below 1 give no row."""

    def eval(self, slots: int, rounds: int, snake: bool):
        for r in range(1, (rounds or 0) + 1):
            for k in range(1, (slots or 0) + 1):
                yield r, slots + 1 - k if snake and r % 2 == 0 else k, (r - 1) * slots + k


@udtf(returnType="member string, first int, last int, at int, played boolean")
class Calendar:
    """For a table argument partitioned by member: every period from a member's first to its last, and whether it has a row.

    Rows have ``member`` and ``at``; one partition is one member, so what is held
    is its distinct periods. Null periods are left out.
    """

    def __init__(self):
        self.member, self.seen = None, set()

    def eval(self, row):
        self.member = row["member"]
        if row["at"] is not None:
            self.seen.add(row["at"])

    def terminate(self):
        if self.seen:
            lo, hi = min(self.seen), max(self.seen)
            for at in range(lo, hi + 1):
                yield self.member, lo, hi, at, at in self.seen


def table_functions(spark: SparkSession) -> None:
    """Registers ``pick_grid`` (for lateral joins) and ``calendar`` (for table arguments) with a session."""
    spark.udtf.register("pick_grid", PickGrid)
    spark.udtf.register("calendar", Calendar)


# ---- builders


@dataclass(frozen=True)
class Builder:
    """A named block of features: the columns that it declares, and the function that makes them from facts."""

    name: str
    columns: tuple[str, ...]
    build: Callable[[DataFrame], DataFrame]


class Refused(ValueError):
    """A builder that may not be used, and why."""


class Builders:
    """Builders by name, joined to the facts' keys only after each has been looked at.

    ``key`` names a row, ``on`` is its period, one of the key. A builder must
    give every column that it declares, one row for each key, and no number that
    is infinite; and for each of the periods in ``checks``, nothing up to that
    period may change when all later facts are taken away.
    """

    def __init__(self, key: Sequence[str], on: str, checks: Sequence[int]):
        self.key, self.on, self.checks = list(key), on, list(checks)
        self.held: dict[str, Builder] = {}

    def add(self, name: str, columns: Sequence[str]):
        """Registers the decorated function; a name or column that is taken already is refused."""

        def put(build: Callable[[DataFrame], DataFrame]):
            if name in self.held:
                raise Refused(f"{name}: the name is taken")
            if taken := {c for b in self.held.values() for c in b.columns} & set(columns):
                raise Refused(f"{name}: another builder has {sorted(taken)}")
            self.held[name] = Builder(name, tuple(columns), build)
            return build

        return put

    def faults(self, name: str, facts: DataFrame) -> dict[str, int]:
        """What is wrong with a builder on these facts, counted: nothing, for one that may be used."""
        b = self.held[name]
        made = b.build(facts)
        if missing := [c for c in (*self.key, *b.columns) if c not in made.columns]:
            return {f"no column {c}": 1 for c in missing}
        own = made.select(*self.key, *b.columns)
        numbers = [c for c, kind in own.dtypes if c in b.columns and kind in ("double", "float")]
        infinite = reduce(lambda x, y: x | y, [F.abs(F.col(c)) == float("inf") for c in numbers], F.lit(False))
        counts = own.agg(F.count_if(F.coalesce(infinite, F.lit(False))).alias("infinite")).first()
        again = own.groupBy(*self.key).count().where("count > 1").count()
        found = {"infinite numbers": counts["infinite"], "repeated keys": again}
        for at in self.checks:
            found[f"rows that later facts change, up to {at}"] = leak_rows(lambda f: b.build(f).select(*self.key, *b.columns), facts, self.on, at, self.key).count()
        return {k: n for k, n in found.items() if n}

    def table(self, facts: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
        """The facts' keys with the columns of the named builders (all of them by default); refuses the first that has a fault.

        Keys that a builder has no row for have nulls there.
        """
        out = facts.select(*self.key).distinct()
        for name in names if names is not None else self.held:
            if wrong := self.faults(name, facts):
                raise Refused(f"{name}: " + ", ".join(f"{n} {k}" for k, n in wrong.items()))
            b = self.held[name]
            out = out.join(b.build(facts).select(*self.key, *b.columns), self.key, "left")
        return out


# ---- line effects

# Intercept and slopes (implied total; spread; game total) of what a team does at a line, and targets to an attempt.
LINE_EFFECTS = {
    "points": (-1.928, 1.1119, 0.0, 0.0),
    "offensive_tds": (-0.9448, 0.15054, 0.0, 0.0),
    "pass_tds": (-0.5106, 0.08921, 0.0, 0.0),
    "rush_tds": (-0.4303, 0.06101, 0.0, 0.0),
    "field_goals": (1.3965, 0.01390, 0.0, 0.0),
    "pass_attempts": (24.70, 0.0, 0.068, 0.184),
    "rush_attempts": (29.68, 0.0, -0.250, -0.081),
}
TARGETS_PER_ATTEMPT = 0.954


def line_effects(rows: DataFrame, implied: str, spread: str, total: str, effects: Mapping[str, Sequence[float]] = LINE_EFFECTS) -> DataFrame:
    """Adds ``line_<name>`` for every row of a coefficient table, and targets from pass attempts; null where a column with a weight is."""
    cols = [F.col(implied), F.col(spread), F.col(total)]
    out = {f"line_{name}": reduce(lambda a, b: a + b, [F.lit(w) * c for w, c in zip(weights, cols, strict=True) if w], F.lit(first)) for name, (first, *weights) in effects.items()}
    if "pass_attempts" in effects:
        out["line_targets"] = TARGETS_PER_ATTEMPT * out["line_pass_attempts"]
    return rows.withColumns(out)


# ---- searches


def simplex_search(rows: DataFrame, loss: Callable[[Sequence[float]], object], start: Sequence[float], size: Sequence[float], low: Sequence[float], high: Sequence[float], rounds: int = 60, tolerance: float = 1e-7) -> tuple[list[float], float, int]:
    """The parameters with the least mean loss by a simplex that reflects, stretches and shrinks: (parameters, loss, passes).

    ``loss`` gives a row's loss as a column for parameters; every round judges
    all its trial points in one pass of sums, and only these means reach the
    driver. Points are kept between ``low`` and ``high``. Rows with a null loss
    are left out of the means. Stops when the corners' losses differ by less
    than ``tolerance``.
    """
    import numpy as np

    low, high = np.asarray(low, float), np.asarray(high, float)
    passes = 0

    def judged(points):
        nonlocal passes
        passes += 1
        got = rows.agg(*[F.avg(loss([float(v) for v in p])).alias(f"l{k}") for k, p in enumerate(points)]).first()
        return [float("inf") if v is None else float(v) for v in got]

    n = len(start)
    corners = [np.clip(np.asarray(start, float), low, high)]
    for k in range(n):
        step = np.zeros(n)
        step[k] = size[k]
        corners.append(np.clip(corners[0] + step, low, high))
    values = judged(corners)
    for _ in range(rounds):
        order = sorted(range(n + 1), key=lambda k: values[k])
        corners, values = [corners[k] for k in order], [values[k] for k in order]
        if values[-1] - values[0] < tolerance:
            break
        mid, worst = np.mean(corners[:-1], axis=0), corners[-1]
        trials = [np.clip(mid + t * (mid - worst), low, high) for t in (1.0, 2.0, 0.5, -0.5)]
        reflected, stretched, outside, inside = judged(trials)
        best = min(range(4), key=lambda k: (reflected, stretched, outside, inside)[k])
        if (reflected, stretched, outside, inside)[best] < values[-1 if best >= 2 else -2]:
            corners[-1], values[-1] = trials[best], (reflected, stretched, outside, inside)[best]
        else:
            corners = [corners[0], *[(c + corners[0]) / 2 for c in corners[1:]]]
            values = [values[0], *judged(corners[1:])]
    k = min(range(n + 1), key=lambda k: values[k])
    return corners[k].tolist(), values[k], passes


def pairs_within(rows: DataFrame, by: Sequence[str], member: str, columns: Sequence[str]) -> DataFrame:
    """All unordered pairs of a group's rows, as ``a`` and ``b`` (structs, a's member the smaller); for groups of bounded size, such as the lines of an order."""
    side = lambda c: rows.select(*by, F.struct(member, *columns).alias(c))
    return side("a").join(side("b"), list(by)).where(F.col(f"a.{member}") < F.col(f"b.{member}"))
