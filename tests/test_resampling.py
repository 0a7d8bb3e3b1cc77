import itertools

import numpy as np
from pyspark.sql import functions as F

from panelyard.operators import resampling

rng = np.random.default_rng(3)


def test_draws_are_poisson_and_the_same_everywhere(spark):
    df = spark.range(40_000).withColumn("w", resampling.times(F.lit(3), F.col("id")))
    got = dict(df.groupBy("w").count().collect())
    assert abs(got[0] / 40_000 - np.exp(-1)) < 0.01 and abs(sum(k * n for k, n in got.items()) / 40_000 - 1) < 0.02
    assert df.repartition(7).where("w = 2").count() == got[2]


def test_two_level_intervals_cover_and_agree_on_reruns(spark):
    """120 samples of 25 groups x 6 members x 3 rows with effects of groups and members: 90 % intervals hold the true mean in about 90 %."""
    rows = []
    for k in range(120):
        for g in range(25):
            eg = rng.normal()
            for m in range(6):
                em = rng.normal() * 0.7
                rows += [(k, g, m, float(2 + eg + em + rng.normal() * 0.5)) for _ in range(3)]
    df = spark.createDataFrame(rows, "k int, g int, m int, x double")
    run = lambda f: {r["k"]: r for r in resampling.two_level_interval(f, ["k"], ["g"], ["m"], F.col("x"), reps=150).collect()}
    got = run(df)
    inside = np.mean([r["low"] <= 2 <= r["high"] for r in got.values()])
    assert 0.82 <= inside <= 0.99, inside
    width = np.mean([r["high"] - r["low"] for r in got.values()])
    assert 0.5 * 3.29 * np.sqrt(1 / 25) < width < 2 * 3.29 * np.sqrt(1 / 25)
    again = run(df.repartition(5))
    assert all(abs(got[k][c] - again[k][c]) < 1e-9 for k in got for c in ("estimate", "low", "high"))
    means = {k: np.mean([r[3] for r in rows if r[0] == k]) for k in range(5)}
    assert all(abs(got[k]["estimate"] - v) < 1e-9 and got[k]["n"] == 450 and got[k]["reps"] == 150 for k, v in means.items())


def test_ratio_nulls_and_one_group(spark):
    df = spark.createDataFrame([("a", 1, 1, 4.0, 2.0), ("a", 1, 2, None, 2.0), ("a", None, 1, 2.0, 1.0), ("b", 1, 1, 1.0, 0.0)], "k string, g int, m int, x double, d double")
    got = {r["k"]: r for r in resampling.two_level_interval(df, ["k"], ["g"], ["m"], F.col("x"), F.col("d"), reps=50).collect()}
    assert got["a"]["estimate"] == 2.0 and got["a"]["n"] == 2 and got["b"]["estimate"] is None and got["b"]["reps"] == 0
    assert resampling.two_level_interval(df.limit(0), ["k"], ["g"], ["m"], F.col("x"), reps=5).count() == 0


def test_pairs_of_every_replicate(spark):
    rows = [(g, m, float(rng.integers(0, 6)), float(rng.integers(0, 6)), float(rng.integers(0, 8))) for g in range(4) for m in range(30)]
    df = spark.createDataFrame([*rows, (0, 99, None, 1.0, 1.0)], "g int, m int, a double, b double, y double")
    for block in (1024, 7):
        got = resampling.pairwise_interval(df, [], ["g"], "m", ("a", "b"), "y", reps=40, block=block).collect()[0]
        weights = {(r["g"], r["m"]): r["w"] for r in df.select("g", "m", F.transform(F.sequence(F.lit(0), F.lit(40)), lambda r: F.when(r == 0, 1).otherwise(resampling.times(r, F.col("g"), F.col("m"), salt="pairs"))).alias("w")).collect()}
        values = []
        for rep in range(41):
            pairs = right = 0
            for g in range(4):
                for p, q in itertools.combinations([r for r in rows if r[0] == g], 2):
                    way, w = np.sign(p[4] - q[4]), weights[g, p[1]][rep] * weights[g, q[1]][rep]
                    if way:
                        pairs += w
                        right += w * (int(np.sign(p[2] - q[2]) == way) - int(np.sign(p[3] - q[3]) == way))
            values.append(right / pairs)
            if not rep:
                assert got["n"] == pairs
        assert abs(got["estimate"] - values[0]) < 1e-12
        assert np.allclose([got["low"], got["high"]], np.quantile(values[1:], [0.05, 0.95])) and abs(got["below_zero"] - np.mean(np.array(values[1:]) < 0)) < 1e-12


def test_grid_value_and_gain_of_every_replicate(spark):
    rows = [(w, w < 20, float(rng.normal(1.4))) for w in range(40) for _ in range(15)]
    df = spark.createDataFrame([*rows, (0, True, None)], "week int, fit boolean, x double")
    losses = {g: (F.col("x") - g) * (F.col("x") - g) for g in (0.5, 1.0, 1.5, 2.0)}
    got = resampling.grid_interval(df, ["week"], F.col("fit"), losses, 1.0, reps=200).collect()[0]
    x = {s: np.array([r[2] for r in rows if r[1] == s]) for s in (True, False)}
    best = min(losses, key=lambda g: ((x[True] - g) ** 2).mean())
    assert got["value"] == best and (got["n_fit"], got["n_test"]) == (300, 300) and got["reps"] == 200
    assert abs(got["gain"] - (((x[False] - 1) ** 2).mean() - ((x[False] - best) ** 2).mean())) < 1e-12
    assert got["value_low"] <= best <= got["value_high"] and got["gain_low"] < got["gain"] < got["gain_high"] and 0.5 < got["share_better"] <= 1
    none = resampling.grid_interval(df.where("fit"), ["week"], F.col("fit"), losses, 1.0, reps=5).collect()[0]
    assert none["n_fit"] == 300 and none["value"] is None


def test_two_level_sums_move_by_replicate_and_not_by_member(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("k"), (F.col("id") % 50).alias("g"), F.col("id").alias("m"), (F.col("id") % 7).alias("v"))
    out = resampling.two_level_interval(rows, ["k"], ["g"], ["m"], F.col("v"), reps=50)
    plan = out._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert moved and not any("m#" in line for line in moved)
    assert "RoundRobinPartitioning" in plan
    assert {r["k"]: (r["n"], r["reps"]) for r in out.collect()} == {0: (1500, 50), 1: (1500, 50)}


def test_two_level_draws_are_those_of_times_and_an_undrawn_row_adds_nothing(spark):
    rows = [(k, g if g else None, m, float(rng.normal()), float(rng.integers(1, 4))) for k in ("a", "b") for g in range(5) for m in range(4) for _ in range(3)]
    df = spark.createDataFrame([*rows, ("b", 1, 1, float("inf"), 1.0)], "k string, g int, m bigint, x double, d double")
    got = {r["k"]: r for r in resampling.two_level_interval(df, ["k"], ["g"], ["m"], F.col("x"), F.col("d"), reps=60).collect()}
    rep, own, inner = F.col("rep"), F.xxhash64("x", "d"), [F.col(c) for c in ("k", "g", "m")]
    w = resampling.times(rep, *inner, own, salt="twor") * resampling.times(rep, *inner[:2], salt="twog") * resampling.times(rep, *inner, salt="twom")
    drawn = df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(60)))).withColumn("w", w).where("w > 0").toPandas()
    for k, d in drawn.groupby("k"):
        values = [(e["w"] * e["x"]).sum() / (e["w"] * e["d"]).sum() for _, e in d.groupby("rep")]
        assert got[k]["reps"] == len(values) and abs(got[k]["low"] - np.quantile(values, 0.05)) < 1e-9 and abs(got[k]["below_zero"] - np.mean(np.array(values) < 0)) < 1e-12
        assert k == "b" or abs(got[k]["high"] - np.quantile(values, 0.95)) < 1e-9
    assert got["b"]["n"] == 61 and got["b"]["high"] == float("inf")


def test_two_level_draws_are_compiled(spark):
    """HotSpot leaves a method of more than 8,000 bytes to its interpreter, where a draw takes many times as long."""
    rows = spark.range(200).select((F.col("id") % 3).cast("string").alias("k"), (F.col("id") % 5).cast("int").alias("season"), (F.col("id") % 7).cast("int").alias("period"), F.col("id").alias("m"), (F.col("id") % 11).cast("double").alias("v"))
    out = resampling.two_level_interval(rows, ["k"], ["season", "period"], ["m"], F.col("v"), reps=20)
    out.collect()
    debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$")
    parts = getattr(debug, "MODULE$").codegenStringSeq(out._jdf.queryExecution().executedPlan())
    sizes = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size()) if "xxhash64" in parts.apply(i)._1()]
    assert sizes and max(sizes) < 4000, sizes
