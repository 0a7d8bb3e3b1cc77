import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelyard.operators import builders
from panelyard.plans import builder_queries, catalog
from panelyard.plans.model_queries import projections
from panelyard.plans.registry import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame([(e, t, (e * 7 + t * 3) % 11) for e in range(6) for t in range(1, 9) if (e + t) % 4], "entity int, t int, pts int")


def registry(build, columns=("x",)):
    held = builders.Builders(["entity", "t"], "t", [3, 6])
    held.add("block", columns)(build)
    return held


def test_a_builder_that_looks_ahead_is_refused(spark, facts):
    whole = Window.partitionBy("entity")
    held = registry(lambda f: f.select("entity", "t", F.max("pts").over(whole).alias("x")))
    with pytest.raises(builders.Refused, match="later facts"):
        held.table(facts)
    with pytest.raises(builders.Refused, match="later facts"):  # it looks ahead in one period only
        registry(lambda f: f.select("entity", "t", F.when(F.col("t") == 6, F.lead("pts").over(Window.partitionBy("entity").orderBy("t"))).alias("x"))).table(facts)


def test_other_faults_and_honest_builders(spark, facts):
    with pytest.raises(builders.Refused, match="no column y"):
        registry(lambda f: f.select("entity", "t"), ("y",)).table(facts)
    with pytest.raises(builders.Refused, match="repeated keys"):
        registry(lambda f: f.select("entity", "t", F.lit(1).alias("x")).unionByName(f.select("entity", "t", F.lit(1).alias("x")))).table(facts)
    with pytest.raises(builders.Refused, match="infinite"):
        registry(lambda f: f.select("entity", "t", F.lit(float("inf")).alias("x"))).table(facts)
    held = registry(lambda f: f.where("t > 2").select("entity", "t", (F.col("pts") * 2).alias("x")))
    with pytest.raises(builders.Refused, match="taken"):
        held.add("block", ["z"])(lambda f: f)
    with pytest.raises(builders.Refused, match="another builder"):
        held.add("second", ["x"])(lambda f: f)
    rows = held.table(facts).collect()
    assert len(rows) == facts.count() and {r["x"] is None for r in rows if r["t"] <= 2} == {True}
    assert builder_queries.honest_builders().faults("gap", Tables(spark, SF).facts.select("entity", "t", "pts")) == {}


def test_grids(spark):
    got = spark.sql("SELECT 1").lateralJoin(builders.PickGrid(F.lit(3), F.lit(2), F.lit(True))).collect()
    assert [(r["round"], r["slot"], r["pick"]) for r in got] == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 3, 4), (2, 2, 5), (2, 1, 6)]
    assert builders.PickGrid(F.lit(None).cast("int"), F.lit(2), F.lit(True)).count() == 0
    builders.table_functions(spark)
    assert spark.sql("SELECT * FROM pick_grid(2, 1, false)").count() == 2
    df = spark.createDataFrame([("a", 2), ("a", 5), ("a", 5), ("b", 1), ("c", None)], "member string, at int")
    rows = builders.Calendar(df.asTable().partitionBy("member")).collect()
    assert sorted((r["member"], r["at"], r["played"]) for r in rows) == [("a", 2, True), ("a", 3, False), ("a", 4, False), ("a", 5, True), ("b", 1, True)]


def test_line_effects_are_null_only_where_they_need_a_number(spark):
    got = builders.line_effects(spark.createDataFrame([(22.0, None, None), (None, 3.0, 44.0)], "i double, s double, g double"), "i", "s", "g").collect()
    assert abs(got[0]["line_points"] - (-1.928 + 1.1119 * 22)) < 1e-12 and got[0]["line_targets"] is None
    assert got[1]["line_points"] is None and abs(got[1]["line_targets"] - 0.954 * (24.7 + 0.068 * 3 + 0.184 * 44)) < 1e-12


def test_simplex_finds_the_least_loss(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(3, 2, 500)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").persist()
    loss = lambda p: F.pow(F.col("x") - p[0], 2) + F.pow(F.lit(p[1]) - 1.5, 2)
    (a, b), value, passes = builders.simplex_search(df, loss, [0.0, 0.0], [1.0, 1.0], [-10, -10], [10, 10], tolerance=1e-8)
    assert abs(a - x.mean()) < 1e-3 and abs(b - 1.5) < 1e-3 and abs(value - x.var()) < 1e-5 and passes < 140
    (a, _), _, _ = builders.simplex_search(df, loss, [0.0, 0.0], [1.0, 1.0], [-10, -10], [1, 10], rounds=40)
    assert a == 1.0


def test_simplex_query_is_no_worse_than_a_grid(spark):
    got = catalog.queries()["m32_simplex"](spark, SF).collect()[0]
    p = projections(Tables(spark, SF)).where("sys_mean IS NOT NULL").toPandas()
    from math import erf

    phi = np.vectorize(lambda v: 0.5 * (1 + erf(v / 2**0.5)))

    def crps(shift, scale):
        sd = scale * np.sqrt(np.maximum(p["sys_mean"], 1.0))
        z = (p["actual"] - shift - p["sys_mean"]) / sd
        return float((sd * (z * (2 * phi(z) - 1) + 2 * np.exp(-z * z / 2) / np.sqrt(2 * np.pi) - 0.5641895835477563)).mean())

    assert abs(crps(got["shift"], got["scale"]) - got["crps"]) < 1e-4 and got["n"] == len(p)
    assert got["crps"] <= min(crps(s, c) for s in np.linspace(-100, 100, 21) for c in np.linspace(2, 40, 20)) + 1e-4
