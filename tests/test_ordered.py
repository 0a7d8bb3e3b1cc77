"""Pairs counted by ranges against pairs formed."""

import itertools

import numpy as np

from panelyard.operators import evaluation, ordered

rng = np.random.default_rng(4)


def test_counts_equal_formed_pairs_whatever_the_range():
    for n, values in ((1, 3), (5, 2), (63, 8), (200, 5), (700, 1000)):
        at, s = rng.integers(0, values, n).astype(float), rng.integers(-values, values, n).astype(float)
        give, ask = rng.integers(0, 4, (n, 3)).astype(float), rng.integers(0, 4, (n, 3)).astype(float)
        hit = (at[None, :] > at[:, None]) & (s[None, :] > s[:, None])
        assert (ordered.before(at, s, give, ask) == np.einsum("ir,ij,jr->r", give, hit.astype(float), ask)).all()
        assert (ordered.apart(at, give, ask) == np.einsum("ir,ij,jr->r", give, (at[None, :] > at[:, None]).astype(float), ask)).all()


def test_groups_are_cut_and_frequent_values_stand_alone(spark):
    """A group of many ranges, half of it one outcome: no task gets a group, and pairs are those of the formed ones."""
    rows = [(g, float(rng.integers(0, 40)), 7.0 if rng.random() < 0.5 else float(rng.integers(0, 30))) for g in (None, 1) for _ in range(300)]
    df = spark.createDataFrame(rows, "g int, p double, y double")
    for gap, block in itertools.product((0.0, 3.0), (8192, 20)):
        got = {r["g"]: (r["pairs"], r["right"]) for r in ordered.ordered_pairs(df, ["g"], ["p"], "y", gap, block=block).collect()}
        for g in (None, 1):
            p, y = (np.array([r[k] for r in rows if r[0] == g]) for k in (1, 2))
            far = y[None, :] - y[:, None] > gap
            assert got[g] == (far.sum(), (far & (p[None, :] > p[:, None])).sum()), (gap, block, g)


def test_no_window_over_a_group(spark):
    """The plan of before ordered each group in one window."""
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 3.0)], "g int, p double, y double")
    plan = evaluation.pairs_over(df, ["p"], "y", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
