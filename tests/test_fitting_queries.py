"""Fitted queries that SQL does not express, against plain refits on the smallest tables."""

import numpy as np
import pandas as pd
import pytest
from test_likelihood import nll, searched
from test_nested import ridge

from panelyard.operators import likelihood
from panelyard.plans import catalog, fitting_queries
from panelyard.plans.model_queries import projections
from panelyard.plans.registry import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: catalog.queries()[name](spark, SF).toPandas()


def test_spread(spark, table):
    got = table("p5_spread_likelihood").sort_values("cat")
    p = fitting_queries.left_of_projections(Tables(spark, SF)).toPandas()
    rows, names = list(p[["cat", "residual", "left", "projected"]].itertuples(index=False, name=None)), list(got["cat"])
    assert got["n"].sum() == len(rows) > 100
    x = np.r_[np.log(got["a"]), np.log(got["b"]), got["g"].iloc[0]]
    assert abs(nll(x, rows, names) - got["nll"].iloc[0]) < 1e-4 and got["nll"].iloc[0] <= searched(rows, names)[1] + 1e-4


def test_gamma_bands(spark, table):
    got = table("m22_gamma_bands").set_index("cat")
    p = projections(Tables(spark, SF)).where("sys_eb > 0 AND actual > 0").toPandas()
    band = (0.1, 0.25, 0.5, 0.75, 0.9)
    for cat, d in p.groupby("cat"):
        z = (d["actual"] / d["sys_eb"]).to_numpy()
        q = np.quantile(z / z.mean(), band)
        assert abs(got.loc[cat, "calibration"] - z.mean()) < 1e-6 and np.allclose(got.loc[cat, "quantiles"], q, atol=1e-6)
        loss = lambda k: ((np.log(likelihood.unit_quantile(k, np.array(band))) - np.log(q)) ** 2).sum()  # noqa: B023, E731
        assert all(loss(got.loc[cat, "shape"]) <= loss(got.loc[cat, "shape"] * s) + 1e-10 for s in (0.95, 0.99, 1.01, 1.05))


def test_blend(spark, table):
    got = table("m20_nested_blend").set_index(["entity", "t"])
    p = projections(Tables(spark, SF)).dropna(subset=["sys_mean", "sys_recent", "sys_eb"]).toPandas()

    def parts(train, test):
        out = [ridge(train[["sys_mean", "sys_recent"]].to_numpy(), train["actual"].to_numpy(), 5.0)(test[["sys_mean", "sys_recent"]].to_numpy())]
        cols = ["sys_recent", "sys_eb"]
        out.append(test["sys_mean"].to_numpy() + ridge(train[cols].to_numpy(), (train["actual"] - train["sys_mean"]).to_numpy(), 5.0)(test[cols].to_numpy()))
        return np.column_stack([*out, test["sys_mean"], test["sys_eb"]])

    checked = 0
    for _, d in p.groupby("cat"):
        for outer in d["season"].unique():
            rest, test = d[d["season"] != outer], d[d["season"] == outer]
            inner = [(s, rest[rest["season"] != s]) for s in sorted(rest["season"].unique())]
            inner = [(rest[rest["season"] == s], train) for s, train in inner if len(train) > 1]
            x, y = np.vstack([parts(train, own) for own, train in inner]), np.concatenate([own["actual"] for own, _ in inner])
            own = parts(rest, test)
            want = ridge(x, y, 1.0)(own)
            mixed = 0.25 * own[:, 2] + 0.25 * own[:, 1] + 0.5 * own[:, 0]
            for e, t, a, b in zip(test["entity"], test["t"], want, mixed, strict=True):
                assert abs(got.loc[(e, t), "blend"] - a) < 1e-3 and abs(got.loc[(e, t), "mixed"] - b) < 1e-3
                checked += 1
    assert checked == len(got) > 100 and got["calibrated"].notna().all()


def test_every_period(spark, table):
    got = table("m33_period_fits").set_index(["entity", "t"])["predicted"]
    f = Tables(spark, SF).facts.toPandas()
    f["q"], f["r"] = f["qty"].where(f["returns"] > 0).astype(float), f["lines"].where(f["lines"] > 1).astype(float)
    for _, d in f.groupby("cat"):
        for t in sorted(d["t"].unique())[::9]:
            past, now = d[d["t"] < t], d[d["t"] == t]
            if len(past) < 2:
                assert all(pd.isna(got[e, t]) for e in now["entity"])
                continue
            fill = past[["q", "r"]].mean().fillna(0.0)
            code = lambda x: np.column_stack([x[["q", "r"]].fillna(fill).to_numpy(), x[["q", "r"]].notna().to_numpy(float)])  # noqa: B023, E731
            want = ridge(code(past), past["pts"].to_numpy(float), 5.0)(code(now))
            assert np.allclose([got[e, t] for e in now["entity"]], want, atol=1e-3)


def test_intervals(spark, table):
    p = projections(Tables(spark, SF)).where("sys_mean IS NOT NULL").toPandas()
    gain = (p["sys_eb"] - p["actual"]).abs() - (p["sys_mean"] - p["actual"]).abs()
    got = table("e11_two_level").set_index("cat")
    for cat, v in gain.groupby(p["cat"]):
        r = got.loc[cat]
        spread = v.std() / np.sqrt(len(v))
        assert abs(r["estimate"] - v.mean()) < 1e-9 and r["n"] == len(v) and r["low"] < r["estimate"] < r["high"]
        assert 1.5 * spread < r["high"] - r["low"] < 12 * spread
    pairs = table("e11_pairs").set_index("cat")
    for cat, d in p.groupby("cat"):
        n = right = 0
        for _, g in d.groupby(["season", "period"]):
            way = np.sign(g["actual"].to_numpy()[:, None] - g["actual"].to_numpy()[None, :])
            hit = [np.sign(g[s].to_numpy()[:, None] - g[s].to_numpy()[None, :]) == way for s in ("sys_mean", "sys_eb")]
            n += (way != 0).sum() / 2
            right += ((hit[0] & (way != 0)).sum() - (hit[1] & (way != 0)).sum()) / 2
        if n:
            assert pairs.loc[cat, "n"] == n and abs(pairs.loc[cat, "estimate"] - right / n) < 1e-12
    study = table("p18_calibration_interval").iloc[0]
    m = fitting_queries.complete_history(Tables(spark, SF)).toPandas()
    from math import erf

    z = (m["mean"] - m["mean_b"]) / np.sqrt(m["sd"] ** 2 + m["sd_b"] ** 2)
    loss = {}
    for k in fitting_queries.GRID:
        q = np.clip([0.5 * (1 + erf(v / k / 2**0.5)) for v in z], 1e-6, 1 - 1e-6)
        loss[k] = -(m["won"] * np.log(q) + (1 - m["won"]) * np.log(1 - q))
    fit = m["season"] <= 1995
    best = min(loss, key=lambda k: loss[k][fit].mean())
    assert study["value"] == best and study["n_fit"] == fit.sum() and study["value_low"] <= best <= study["value_high"]
    assert abs(study["gain"] - (loss[1.0][~fit].mean() - loss[best][~fit].mean())) < 1e-6


@pytest.fixture(scope="module")
def ahead(spark):
    """The facts with the next period's points."""
    f = Tables(spark, SF).facts.toPandas().sort_values(["entity", "t"]).reset_index(drop=True)
    f["y"] = f.groupby("entity")["pts"].shift(-1)
    return f[f["y"].notna()]


def test_ablation_equals_refits(table, ahead):
    got = table("m28_ablation").set_index(["features", "cat"])
    sets = {"one": ["qty"], "two": ["qty", "lines"], "all": ["qty", "lines", "returns"]}
    assert len(got) == 3 * ahead["cat"].nunique()
    for name, cols in sets.items():
        for cat, d in ahead.groupby("cat"):
            sse = sum(((ridge(d.loc[d["season"] != s, cols].to_numpy(float), d.loc[d["season"] != s, "y"].to_numpy(), 5.0)(own[cols].to_numpy(float)) - own["y"]) ** 2).sum() for s, own in d.groupby("season"))
            assert got.loc[(name, cat), "n"] == len(d) and abs(got.loc[(name, cat), "mse"] - sse / len(d)) < 1e-3 * sse / len(d)


def test_frozen_holdout_equals_one_fit(table, ahead):
    got = table("e26_frozen_holdout").set_index(["entity", "t"])["predicted"]
    cols, checked = ["qty", "lines"], 0
    for _, d in ahead.groupby("cat"):
        old, new = d[d["season"] <= 1997], d[d["season"] > 1997]
        want = ridge(old[cols].to_numpy(float), old["y"].to_numpy(), 5.0)(new[cols].to_numpy(float))
        assert np.allclose([got[k] for k in zip(new["entity"], new["t"], strict=True)], want, atol=1e-4)
        checked += len(new)
    assert checked == len(got) > 100


def test_median_line_is_no_worse_than_any_near_it(spark, table):
    got = table("m7_median_line").set_index(["entity", "t"])["calibrated"]
    p = projections(Tables(spark, SF)).dropna().toPandas()
    line = np.array([got[k] for k in zip(p["entity"], p["t"], strict=True)])
    slope, first = np.polyfit(p["sys_mean"], line, 1)
    assert np.allclose(first + slope * p["sys_mean"], line, atol=1e-2)
    loss = lambda a, b: np.abs(p["actual"] - a - b * p["sys_mean"]).mean()
    assert all(loss(first, slope) <= loss(first + da, slope + db) + 0.02 for da in (-20, -5, 0, 5, 20) for db in (-0.05, -0.01, 0, 0.01, 0.05))


def test_bootstrap_interval_is_that_of_whole_periods(spark, table):
    got = table("e11_bootstrap").iloc[0]
    p = projections(Tables(spark, SF)).where("sys_mean IS NOT NULL").toPandas()
    error = (p["sys_mean"] - p["actual"]).abs()
    sums = error.groupby([p["season"], p["period"]]).agg(["sum", "count"])
    rng = np.random.default_rng(1)
    means = [s["sum"].sum() / s["count"].sum() for s in (sums.iloc[rng.integers(0, len(sums), len(sums))] for _ in range(1000))]
    assert got["reps"] == 200
    for name, q in (("q05", 0.05), ("q50", 0.5), ("q95", 0.95)):  # within the noise of two hundred draws
        assert abs(got[name] - np.quantile(means, q)) < 0.6 * np.std(means), (name, got[name], np.quantile(means, q))
