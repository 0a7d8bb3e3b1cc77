import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.operators import likelihood

rng = np.random.default_rng(5)


def nll(x, rows, names):
    k = len(names)
    a, b = (np.exp(x[s])[[names.index(r[0]) for r in rows]] for s in (slice(k), slice(k, 2 * k)))
    r, f, p = (np.array([row[i] for row in rows]) for i in (1, 2, 3))
    sd = f ** (x[-1] / 2) * (a + b * np.maximum(p, 0)) + 1e-6
    return np.mean(np.log(sd) + r * r / (2 * sd * sd) + 0.9189385332046727)


def searched(rows, names):
    """The least value by coordinate steps that shrink: slow and plain."""
    x = np.r_[np.full(len(names), 0.7), np.full(len(names), -1.0), 1.0]
    best, size = nll(x, rows, names), 0.5
    while size > 1e-6:
        moved = False
        for i in range(len(x)):
            for s in (size, -size):
                y = x.copy()
                y[i] += s
                y = np.clip(y, -5, [3] * (len(x) - 1) + [2.0])
                y[-1] = max(y[-1], 0.3)
                if (v := nll(y, rows, names)) < best - 1e-14:
                    x, best, moved = y, v, True
        size = size if moved else size / 2
    return x, best


def test_spread_recovers_planted_parameters_and_no_search_is_better(spark):
    names, a, b, g = ["QB", "RB", "K"], {"QB": 3.0, "RB": 1.2, "K": 2.0}, {"QB": 0.3, "RB": 0.55, "K": 0.1}, 1.3
    rows = []
    for c in names:
        for _ in range(2500):
            f, p = rng.uniform(0.05, 1), rng.uniform(-1, 25)
            rows.append((c, float(rng.normal() * f ** (g / 2) * (a[c] + b[c] * max(p, 0))), float(f), float(p)))
    odd = [("X", 5.0, 0.5, 3.0), ("QB", None, 0.5, 3.0), ("QB", 3.0, 0.0, 3.0), (None, 3.0, 0.2, 3.0)]
    frame = spark.createDataFrame(rows + odd, "pos string, r double, f double, p double")
    got = {r["pos"]: r for r in likelihood.spread_likelihood(frame, "pos", [*names, "DEF"], "r", "f", "p").collect()}
    for c in names:
        assert abs(got[c]["a"] - a[c]) < 0.35 and abs(got[c]["b"] - b[c]) < 0.06 and abs(got[c]["g"] - g) < 0.05 and got[c]["n"] == 2500
    assert got["DEF"]["n"] == 0
    x, best = searched(rows, names)
    assert got["QB"]["nll"] <= best + 1e-7
    assert all(abs(np.log(got[c]["a"]) - x[i]) < 0.02 for i, c in enumerate(names))
    empty = likelihood.spread_likelihood(frame.limit(0), "pos", names, "r", "f", "p").collect()
    assert [r["n"] for r in empty] == [0, 0, 0]


def test_digamma_and_trigamma(spark):
    df = spark.createDataFrame([(float(x),) for x in (0.05, 0.3, 1, 2.5, 10, 400)], "x double").select("x", likelihood.digamma(F.col("x")).alias("d"), likelihood.trigamma(F.col("x")).alias("t"))
    from math import lgamma

    for r in df.collect():
        x, h = r["x"], 1e-5 * max(r["x"], 0.05)
        assert abs(r["d"] - (lgamma(x + h) - lgamma(x - h)) / (2 * h)) < 1e-4 * (1 + abs(r["d"]))
    known = {r["x"]: r for r in df.collect()}
    assert abs(known[1.0]["d"] + 0.5772156649015329) < 1e-12 and abs(known[1.0]["t"] - np.pi**2 / 6) < 1e-10


@pytest.mark.parametrize("shape", [0.3, 2.0, 40.0])
def test_gamma_shape_is_the_numeric_optimum(spark, shape):
    from math import lgamma

    x = rng.gamma(shape, 3.0, 4000)
    frame = spark.createDataFrame([("a", float(v)) for v in x] + [("a", 0.0), ("a", None), ("b", 2.0), ("b", 2.0)], "k string, x double")
    got = {r["k"]: r for r in likelihood.gamma_likelihood(frame, ["k"], "x").collect()}
    d = np.log(x.mean()) - np.log(x).mean()

    def value(t):
        k = np.exp(t)
        return k * (t - d) - lgamma(k) - k

    lo, hi = np.log(0.01), np.log(1000)
    for _ in range(200):
        p, q = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (p, hi) if value(p) < value(q) else (lo, q)
    assert abs(got["a"]["shape"] / np.exp((lo + hi) / 2) - 1) < 1e-6 and got["b"]["shape"] is None and got["a"]["n"] == 4000


def test_shapes_by_quantiles(spark):
    expect = rng.uniform(2, 30, 6000)
    x = rng.gamma(3.0, 1 / 3.0, 6000) * expect * 1.2
    frame = spark.createDataFrame([("a", float(v), float(e)) for v, e in zip(x, expect, strict=True)] + [("a", None, 2.0), ("a", 3.0, 0.0), ("z", 0.0, 1.0), ("z", 0.0, 2.0)], "k string, x double, e double")
    got = {r["k"]: r for r in likelihood.gamma_bands(frame, ["k"], "x", "e").collect()}
    z = x / expect
    assert np.allclose(got["a"]["quantiles"], np.quantile(z / z.mean(), (0.1, 0.25, 0.5, 0.75, 0.9)))
    assert abs(got["a"]["shape"] - 3.0) < 0.25 and abs(got["a"]["calibration"] - z.mean()) < 1e-9 and got["z"]["shape"] is None
    target = np.log(np.array(got["a"]["quantiles"]))
    loss = lambda k: float(((np.log(likelihood.unit_quantile(k, np.array((0.1, 0.25, 0.5, 0.75, 0.9)))) - target) ** 2).sum())
    assert all(loss(got["a"]["shape"]) <= loss(got["a"]["shape"] * s) + 1e-12 for s in (0.99, 0.999, 1.001, 1.01))
    assert abs(likelihood.unit_quantile(1.0, np.array(0.5)) - np.log(2)) < 1e-12


def test_exact_quantiles_and_residual_bands(spark):
    sizes = {"big": 5000, "few": 3, "one": 1}
    data = {k: rng.normal(size=n) * 3 for k, n in sizes.items()}
    data["same"] = np.zeros(800)
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("none", None), ("big", None)]
    frame = spark.createDataFrame(rows, "k string, v double")
    levels = (0.05, 0.25, 0.5, 0.9)
    got = {r["k"]: r["quantiles"] for r in likelihood.exact_quantiles(frame, ["k"], "v", levels).collect()}
    assert all(np.allclose(got[k], np.quantile(v, levels)) for k, v in data.items())
    pooled = np.quantile(np.concatenate(list(data.values())), (np.arange(20) + 0.5) / 20)
    bands = {r["k"]: r for r in likelihood.residual_bands(frame, ["k"], "v", levels).collect()}
    for k in (*data, "none"):
        own = data.get(k, np.zeros(0))
        assert bands[k]["n"] == len(own) and np.allclose(bands[k]["quantiles"], np.quantile(np.concatenate([own, pooled]), levels))
