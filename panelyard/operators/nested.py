"""Models within models: blends whose parts never see the season they are judged on, and fits of every period, all from summed products."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.operators.estimators import gram


def matrix(row: dict, size: int) -> np.ndarray:
    """The symmetric matrix of a row of ``gram``."""
    return np.array([[row[f"s_{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)], dtype=float)


def ridge_weights(g: np.ndarray, lam: float) -> np.ndarray:
    """Weights of (1, columns) in their own units, of a standardised ridge of the last row of summed products on the others; columns that do not vary get 0."""
    n, k = g[0, 0], len(g) - 2
    mean = g[0, 1:-1] / n
    cross = g[1:-1, 1:-1] - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cross), 0) / max(n - 1, 1))
    flat = sd <= 1e-12 * np.sqrt(np.maximum(np.diag(g)[1:-1], 1e-300) / n)
    use = np.where(flat, 1.0, sd)
    beta = np.linalg.solve(cross / np.outer(use, use) + lam * np.eye(k), (g[1:-1, -1] - mean * g[0, -1]) / use) / use
    beta[flat] = 0.0
    return np.r_[g[0, -1] / n - beta @ mean, beta]


def _blend(seasons: Mapping[int, np.ndarray], names: Sequence[str], bases: Mapping[str, tuple[Sequence[str], str | None]], raw: Sequence[str], lam: float, meta_lam: float, mix: Mapping[str, float]):
    """For every outer season: the weights over (1, names) of the blend and the mix, and those of the inner rows of each other season.

    ``seasons`` has each season's products of (1, names, target). A part is
    a ridge of the target, less ``minus`` where it has one, whose prediction adds
    it again. All that is fitted is linear in the columns, so a meta column is a
    vector of weights and its products follow from those of the columns.
    """
    at = {n: i for i, n in enumerate(["1", *names])}
    y = len(names) + 1
    unit = np.eye(y + 1)

    def part(g: np.ndarray, cols: Sequence[str], minus: str | None) -> np.ndarray:
        goal = unit[y] - (unit[at[minus]] if minus else 0)
        pick = np.vstack([unit[[0, *(at[c] for c in cols)]], goal])
        w = ridge_weights(pick @ g @ pick.T, lam) @ pick[:-1]
        return w + (unit[at[minus]] if minus else 0)

    def columns(g: np.ndarray) -> np.ndarray:
        """A row of weights for each meta column: parts fitted on g, and raw columns."""
        return np.vstack([*(part(g, cols, minus) for cols, minus in bases.values()), *(unit[at[c]] for c in raw)])

    order = [*bases, *raw]
    mixing = np.array([mix.get(c, 0.0) for c in order])
    out = {}
    for outer in seasons:
        rest = {s: g for s, g in seasons.items() if s != outer}
        inner = {}
        for s in rest:
            train = [g for t, g in rest.items() if t != s]
            if train and sum(g[0, 0] for g in train) > 1:
                inner[s] = columns(sum(train))
        if not inner:
            continue
        stacked = sum(p @ seasons[s] @ p.T for s, m in inner.items() for p in [np.vstack([unit[:1], m, unit[y : y + 1]])])
        meta = ridge_weights(stacked, meta_lam)
        own = columns(sum(rest.values()))
        blend = lambda m: meta[0] * unit[0] + meta[1:] @ m  # noqa: B023, E731
        out[outer] = (blend(own), mixing @ own, {s: (blend(m), mixing @ m) for s, m in inner.items()})
    return out


def nested_blend(df: DataFrame, by: Sequence[str], season: str, bases: Mapping[str, tuple[Sequence[str], str | None]], raw: Sequence[str], target: str, mix: Mapping[str, float], lam: float = 5.0, meta_lam: float = 1.0, rounds: int = 30) -> DataFrame:
    """Adds ``blend``, ``mixed``, ``averaged`` and ``calibrated`` to the rows: predictions of each season by models that never saw it.

    ``bases`` names the parts: their columns, and a column that their target is
    the residual of (or None). The blend is a small ridge of the target on the
    parts' predictions and ``raw`` columns; it is fitted on predictions of inner
    seasons by parts that saw neither these nor the outer season, so a part that
    knows its own season gains nothing. ``mixed`` is the fixed mix of the same
    columns, ``averaged`` the mean of both, and ``calibrated`` the median line of
    the outcome on it (least absolute deviations, fitted on the inner seasons'
    predictions over all groups).

    The rows are summed once, to the products of all columns by group and season;
    every inner and outer fit is a difference of these, solved group by group in
    tasks. The calibration sends five sums an outer season and round to the
    driver. Rows with a null column or season have null predictions, as have
    groups of fewer than three seasons.
    """
    names = list(dict.fromkeys([*raw, *(c for cols, minus in bases.values() for c in (*cols, *([minus] if minus else [])))]))
    size, key = len(names) + 2, list(by)
    whole = df.dropna(subset=[*names, season])
    sums = gram(whole.where(F.col(target).isNotNull()), [*key, season], names, target)
    kinds = dict(df.dtypes)
    weights = "array<double>"
    schema = ", ".join([*(f"`{b}` {kinds[b]}" for b in key), f"outer_season {kinds[season]}, `{season}` {kinds[season]}, w_blend {weights}, w_mixed {weights}"])

    def solve(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        grams = {r[season]: matrix(r, size) for r in rows}
        out = []
        for outer, (blend, mixed, inner) in _blend(dict(sorted(grams.items())), names, bases, raw, lam, meta_lam, mix).items():
            head = [rows[0][b] for b in key]
            out.append((*head, outer, outer, blend[:-1].tolist(), mixed[:-1].tolist()))
            out += [(*head, outer, s, a[:-1].tolist(), b[:-1].tolist()) for s, (a, b) in inner.items()]
        columns = [*key, "outer_season", season, "w_blend", "w_mixed"]
        kinds_of = [*(table.schema.field(b).type for b in key), table.schema.field(season).type, table.schema.field(season).type, pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.table({c: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate(zip(columns, kinds_of, strict=True))})

    fits = (sums.groupBy(*key) if key else sums.groupBy(F.lit(1))).applyInArrow(solve, schema).persist()  # a few numbers a group and pair of seasons
    value = lambda w: reduce(lambda a, b: a + b, [F.get(w, F.lit(i + 1)) * F.col(n).cast("double") for i, n in enumerate(names)], F.get(w, F.lit(0)))
    predicted = lambda rows: rows.withColumn("blend", value(F.col("w_blend"))).withColumn("mixed", value(F.col("w_mixed"))).drop("w_blend", "w_mixed").withColumn("averaged", (F.col("blend") + F.col("mixed")) / 2)
    inner = predicted(whole.where(F.col(target).isNotNull()).join(fits.where(F.col("outer_season") != F.col(season)), [*key, season])).select("outer_season", "averaged", F.col(target).cast("double").alias("y")).persist()
    lines = median_lines(inner, "outer_season", "averaged", "y", rounds)
    inner.unpersist()
    own = fits.where(F.col("outer_season") == F.col(season)).drop("outer_season")
    complete = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
    out = predicted(df.join(own, [*key, season], "left"))
    line = lambda k: F.coalesce(*[F.when(F.col(season) == s, F.lit(v[k])) for s, v in lines.items()]) if lines else F.lit(None).cast("double")
    out = out.withColumn("calibrated", line(0) + line(1) * F.col("averaged"))
    return out.withColumns({c: F.when(complete, F.col(c)) for c in ("blend", "mixed", "averaged", "calibrated")})


def median_lines(df: DataFrame, by: str, x: str, y: str, rounds: int = 30, least: float = 1e-4) -> dict:
    """Least absolute deviations of y on x for each value of ``by`` (few, as seasons), by reweighted least squares: five sums a value and round."""
    lines: dict = {}
    settled: set = set()
    for k in range(rounds):
        on = lambda i: F.coalesce(*[F.when(F.col(by) == s, F.lit(float(v[i]))) for s, v in lines.items()], F.lit(0.0))  # noqa: B023, E731
        w = F.lit(1.0) if not k else 1.0 / F.greatest(F.abs(F.col(y) - on(0) - on(1) * F.col(x)), F.lit(least))
        sums = df.groupBy(by).agg(F.sum(w).alias("w"), F.sum(w * F.col(x)).alias("x"), F.sum(w * F.col(y)).alias("y"), F.sum(w * F.col(x) * F.col(x)).alias("xx"), F.sum(w * F.col(x) * F.col(y)).alias("xy")).collect()
        for s in sums:
            if s[by] in settled:
                continue
            det = s["w"] * s["xx"] - s["x"] ** 2 if s["w"] else 0.0
            if not det > 1e-12 * max(1.0, s["w"] * s["xx"]):
                lines.setdefault(s[by], (0.0, 1.0))
                settled.add(s[by])
                continue
            b = (s["w"] * s["xy"] - s["x"] * s["y"]) / det
            new = ((s["y"] - b * s["x"]) / s["w"], b)
            if k and abs(new[0] - lines[s[by]][0]) + abs(new[1] - lines[s[by]][1]) < 1e-9:
                settled.add(s[by])
            lines[s[by]] = new
        if len(settled) == len(sums):
            break
    return lines


# ---- a fit for every period


def period_fits(df: DataFrame, by: Sequence[str], on: str, cols: Sequence[str], target: str, lam: float = 5.0, least: int = 2) -> DataFrame:
    """The model of every period, fitted on all periods before it: ``by``, ``on``, ``n``, and arrays ``fill`` and ``weights`` (the intercept first).

    A null column is filled with the mean of its known values over the same
    earlier periods, and where it was ever null it has a second weight for being
    known. Both are linear in (value or 0, whether it is known), so the sums of
    products of these, by period, carry every later model: each is a running sum,
    and rows are read once however many periods there are. Groups are solved in
    tasks; a group's rows there are its periods. Periods with fewer than
    ``least`` earlier rows have no model, rows with a null target or period train
    none.
    """
    key, names = list(by), [*cols, *(f"{c}__known" for c in cols)]
    rows = df.where(F.col(target).isNotNull() & F.col(on).isNotNull())
    rows = rows.select(*key, on, F.col(target).cast("double").alias("__y"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols], *[F.col(c).isNotNull().cast("double").alias(f"{c}__known") for c in cols])
    sums = gram(rows, [*key, on], names, "__y")
    periods = df.where(F.col(on).isNotNull()).select(*key, on).distinct()
    sums = periods.join(sums, [*key, on], "left").fillna(0.0, [c for c in sums.columns if c.startswith("s_")])
    size, k = len(names) + 2, len(cols)
    kinds = dict(df.dtypes)

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by(on)
        total, out = np.zeros((size, size)), []
        for r in table.to_pylist():
            if total[0, 0] >= least:
                n = total[0, 0]
                known = total[0, 1 + k : 1 + 2 * k]
                fill = np.where(known > 0, total[0, 1 : 1 + k] / np.maximum(known, 1), 0.0)
                # value filled = value or 0, plus fill where it is not known
                to = np.zeros((size, size))
                to[0, 0] = to[-1, -1] = 1
                for i in range(k):
                    to[1 + i, 1 + i], to[1 + i, 0], to[1 + i, 1 + k + i] = 1, fill[i], -fill[i]
                    to[1 + k + i, 1 + k + i] = 1
                out.append((*[r[b] for b in key], r[on], int(n), fill.tolist(), ridge_weights(to @ total @ to.T, lam).tolist()))
            total = total + matrix(r, size)
        columns = [*key, on, "n", "fill", "weights"]
        kinds_of = [*(table.schema.field(c).type for c in (*key, on)), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(zip(columns, kinds_of, strict=True))})

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*key, on)), "n long, fill array<double>, weights array<double>"])
    return (sums.groupBy(*key) if key else sums.groupBy(F.lit(1))).applyInArrow(solve, schema)


def period_predictions(df: DataFrame, fits: DataFrame, by: Sequence[str], on: str, cols: Sequence[str], name: str = "predicted") -> DataFrame:
    """Every row by its own period's model, encoded as that model's training rows were; null where there is no model."""
    k = len(cols)
    terms = [F.get("weights", F.lit(1 + i)) * F.coalesce(F.col(c).cast("double"), F.get("fill", F.lit(i))) + F.get("weights", F.lit(1 + k + i)) * F.col(c).isNotNull().cast("double") for i, c in enumerate(cols)]
    return df.join(fits.drop("n"), [*by, on], "left").withColumn(name, reduce(lambda a, b: a + b, terms, F.get("weights", F.lit(0)))).drop("fill", "weights")
