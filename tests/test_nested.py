import numpy as np
import pandas as pd

from panelyard.operators import nested

rng = np.random.default_rng(11)


def ridge(x, y, lam):
    mu, sd = x.mean(axis=0), x.std(axis=0, ddof=1)
    flat = sd < 1e-9
    sd = np.where(flat, 1, sd)
    z = (x - mu) / sd
    beta = np.linalg.solve(z.T @ z + lam * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    beta[flat] = 0
    return lambda v: y.mean() + (v - mu) / sd @ beta


def made(n=70, groups=("A", "B"), seasons=(1, 2, 3, 4)):
    rows = []
    for g in groups:
        for s in seasons:
            for k in range(n):
                x1, x2, out = rng.normal(size=3)
                y = 2 * x1 - x2 + 3 * out + rng.normal()
                rows.append((g, s, f"{g}{s}{k}", float(x1), float(x2), float(out + 0.3 * rng.normal()), float(y)))
    return pd.DataFrame(rows, columns=["g", "season", "id", "x1", "x2", "feed", "y"])


BASES = {"direct": (["x1", "x2"], None), "over": (["x1"], "feed")}
MIX = {"feed": 0.5, "direct": 0.5}


def parts(train, test):
    direct = ridge(train[["x1", "x2"]].to_numpy(), train["y"].to_numpy(), 5.0)(test[["x1", "x2"]].to_numpy())
    over = test["feed"].to_numpy() + ridge(train[["x1"]].to_numpy(), (train["y"] - train["feed"]).to_numpy(), 5.0)(test[["x1"]].to_numpy())
    return np.column_stack([direct, over, test["feed"].to_numpy()])


def by_refitting(df):
    out, inner_rows = {}, {}
    for g, d in df.groupby("g"):
        for outer in sorted(d["season"].unique()):
            rest, test = d[d["season"] != outer], d[d["season"] == outer]
            inner = [(parts(rest[rest["season"] != s], rest[rest["season"] == s]), rest[rest["season"] == s]) for s in sorted(rest["season"].unique())]
            x, y = np.vstack([p for p, _ in inner]), np.concatenate([t["y"].to_numpy() for _, t in inner])
            meta, own = ridge(x, y, 1.0), parts(rest, test)
            mixed = 0.5 * own[:, 2] + 0.5 * own[:, 0]
            for i, a, b in zip(test["id"], meta(own), mixed, strict=True):
                out[i] = (a, b, (a + b) / 2)
            inner_rows.setdefault(outer, []).append(np.column_stack([(meta(x) + 0.5 * x[:, 2] + 0.5 * x[:, 0]) / 2, y]))
    return out, {s: np.vstack(v) for s, v in inner_rows.items()}


def test_blend_equals_refitting_every_fold(spark):
    df = made()
    odd = pd.DataFrame([("A", 1, "null", None, 1.0, 1.0, 2.0), ("C", 1, "alone", 1.0, 1.0, 1.0, 2.0), ("A", 2, "unplayed", 1.0, 1.0, 1.0, None)], columns=df.columns)
    got = {r["id"]: r for r in nested.nested_blend(spark.createDataFrame(pd.concat([df, odd])).replace(float("nan"), None), ["g"], "season", BASES, ["feed"], "y", MIX).collect()}
    want, inner = by_refitting(df)
    assert set(got) == set(df["id"]) | set(odd["id"])
    for i, (a, b, c) in want.items():
        assert abs(got[i]["blend"] - a) < 1e-8 and abs(got[i]["mixed"] - b) < 1e-8 and abs(got[i]["averaged"] - c) < 1e-8
    assert got["null"]["blend"] is None and got["alone"]["blend"] is None and got["unplayed"]["blend"] is not None
    for s, rows in inner.items():  # the line is no worse than any near it
        some = [r for r in got.values() if r["season"] == s and r["averaged"] is not None][:2]
        slope = (some[0]["calibrated"] - some[1]["calibrated"]) / (some[0]["averaged"] - some[1]["averaged"])
        a = some[0]["calibrated"] - slope * some[0]["averaged"]
        loss = lambda p, q: np.abs(rows[:, 1] - p - q * rows[:, 0]).sum()  # noqa: B023, E731
        assert all(loss(a, slope) <= loss(a + da, slope + db) + 0.02 for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05))


def test_a_part_that_knows_its_own_season_gains_nothing(spark):
    """``peek`` tells each season's outcomes exactly, but by another sign and size in every season."""
    df = made(groups=("A",), seasons=(1, 2, 3, 4, 5, 6))
    df["peek"] = df["y"] * df["season"].map({1: 1, 2: -1, 3: 2, 4: -2, 5: 1.5, 6: -1.5})
    frame = spark.createDataFrame(df)
    error = lambda bases: np.mean([abs(r["blend"] - r["y"]) for r in nested.nested_blend(frame, ["g"], "season", bases, ["feed"], "y", MIX, rounds=2).collect()])
    honest = error(BASES)
    assert error({**BASES, "peeks": (["peek"], None)}) > honest * 0.9
    within = df.groupby("season").apply(lambda d: np.abs(ridge(d[["peek"]].to_numpy(), d["y"].to_numpy(), 5.0)(d[["peek"]].to_numpy()) - d["y"]).mean()).mean()
    assert within < honest / 3  # what it would seem to gain if judged on the season that it knows


def test_every_period_equals_a_refit_on_those_before(spark):
    rows = []
    for g in "AB":
        for w in range(1, 7):
            for _ in range(12):
                a, b = rng.normal(size=2)
                rows.append((g, w, float(a) if rng.random() < 0.7 else None, float(b), float(3 * a - b + rng.normal())))
    rows += [("A", 9, 1.0, None, None), ("A", None, 1.0, 1.0, 1.0), ("Z", 1, 1.0, 1.0, 1.0)]
    df = pd.DataFrame(rows, columns=["g", "w", "a", "b", "y"]).reset_index(names="id")
    frame = spark.createDataFrame([tuple(None if isinstance(v, float) and v != v else v for v in r) for r in df.astype(object).itertuples(index=False)], "id long, g string, w double, a double, b double, y double")
    fits = nested.period_fits(frame, ["g"], "w", ["a", "b"], "y")
    got = {r["id"]: r["predicted"] for r in nested.period_predictions(frame, fits, ["g"], "w", ["a", "b"]).collect()}
    for _, r in df.iterrows():
        past = df[(df["g"] == r["g"]) & (df["w"] < r["w"]) & df["y"].notna()]
        if len(past) < 2:
            assert got[r["id"]] is None
            continue
        fill = past[["a", "b"]].mean()
        code = lambda d: np.column_stack([d[["a", "b"]].fillna(fill).to_numpy(dtype=float), d[["a", "b"]].notna().to_numpy(dtype=float)])  # noqa: B023, E731
        want = ridge(code(past), past["y"].to_numpy(dtype=float), 5.0)(code(r.to_frame().T.astype({"a": float, "b": float})))[0]
        assert abs(got[r["id"]] - want) < 1e-7
