"""Every registered panel query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from panelyard.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    cell = lambda v: "null" if v is None or v != v else f"{float(v) + 0.0:.8g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), names)


@pytest.fixture(scope="module")
def panel(spark):
    """The facts with the next period's points, as pandas."""
    from panelyard.plans.registry import Tables

    f = Tables(spark, SF).facts.toPandas().sort_values(["entity", "t"]).reset_index(drop=True)
    f["y"] = f.groupby("entity")["pts"].shift(-1)
    return f


def ridge(train, rows, cols, lam=5.0):
    import numpy as np

    x, y = train[cols].to_numpy(dtype=float), train["y"].to_numpy(dtype=float)
    mu, sd = x.mean(axis=0), x.std(axis=0, ddof=1)
    z = (x - mu) / sd
    beta = np.linalg.solve(z.T @ z + lam * np.eye(len(cols)), z.T @ (y - y.mean()))
    return y.mean() + (rows[cols].to_numpy(dtype=float) - mu) / sd @ beta


COLS = ["qty", "lines", "returns"]


def test_ridge_by_group_equals_normal_equations(spark, panel):
    import numpy as np

    got = catalog.queries()["m4_m5_ridge_by_group"](spark, SF).toPandas().set_index(["entity", "t"])["predicted"]
    for _, rows in panel[panel["y"].notna()].groupby("cat"):
        assert np.allclose(got.loc[list(zip(rows["entity"], rows["t"], strict=True))], ridge(rows, rows, COLS), atol=1e-4)


def test_season_folds_leave_their_season_out(spark, panel):
    import numpy as np

    got = catalog.queries()["e6_season_folds"](spark, SF).toPandas().set_index(["entity", "t"])["predicted"]
    known = panel[panel["y"].notna()]
    for (cat, season), rows in known.groupby(["cat", "season"]):
        rest = known[(known["cat"] == cat) & (known["season"] != season)]
        assert np.allclose(got.loc[list(zip(rows["entity"], rows["t"], strict=True))], ridge(rest, rows, COLS), atol=1e-4)


def test_penalty_sweep_equals_refits(spark, panel):
    got = catalog.queries()["m29_penalty_sweep"](spark, SF).toPandas()
    known = panel[panel["y"].notna()]
    assert len(got) == 15
    for r in got.itertuples():
        sse = n = 0
        for season in known["season"].unique():
            rows = known[(known["cat"] == r.cat) & (known["season"] == season)]
            rest = known[(known["cat"] == r.cat) & (known["season"] != season)]
            sse, n = sse + ((ridge(rest, rows, COLS, r.penalty) - rows["y"]) ** 2).sum(), n + len(rows)
        assert r.n == n and abs(r.mse - sse / n) < 1e-3 * r.mse


def test_expected_poisson_has_the_stated_tail(spark):
    import math

    from pyspark.sql import functions as F

    from panelyard.operators.market import expected_poisson

    df = spark.createDataFrame([(x + 0.5, p) for x in (0, 2, 7) for p in (0.06, 0.3, 0.5, 0.94, 0.99)], "line double, p double")
    for r in df.withColumn("m", expected_poisson(F.col("line"), F.col("p"))).collect():
        if r["p"] > 0.95:
            assert r["m"] is None
        else:
            tail = 1 - sum(math.exp(-r["m"]) * r["m"] ** k / math.factorial(k) for k in range(int(r["line"]) + 1))
            assert abs(tail - r["p"]) < 1e-8
    rows = catalog.queries()["k4_expected_poisson"](spark, SF).collect()
    assert rows and not [r for r in rows for v in r if isinstance(v, float) and v != v]


def test_playoff_probability_equals_convolution(spark, panel):
    import numpy as np

    got = {r["entity"]: r for r in catalog.queries()["p2_playoff_probability"](spark, SF).collect()}
    assert set(got) == set(panel["entity"])
    for entity, rows in panel.groupby("entity"):
        p = (rows["qty"] % 100 / 100).to_numpy()
        pmf = np.ones(1)
        for x in p[:-1]:
            pmf = np.convolve(pmf, [1 - x, x])
        want = p[-1] * pmf[5:].sum() + (1 - p[-1]) * pmf[6:].sum()
        assert abs(got[entity]["playoffs"] - want) < 1e-8 and abs(got[entity]["leverage"] - (pmf[5] if len(pmf) > 5 else 0)) < 1e-8


def test_convolved_sides_are_probabilities_and_deals_keep_every_point(spark):
    p = [r["p_a"] for r in catalog.queries()["p9_convolved_sides"](spark, SF).collect()]
    assert p and all(0 <= x <= 1 for x in p) and 0.3 < sum(p) / len(p) < 0.7


def test_bootstrap_holds_the_mean(spark):
    rows = catalog.queries()["e11_bootstrap"](spark, SF).collect()
    assert rows and all(r[k] is not None for r in rows for k in r.__fields__)


def test_calibration_study_chooses_on_the_other_seasons(spark):
    import math

    from panelyard.plans.decision_queries import history
    from panelyard.plans.registry import Tables

    m = history(Tables(spark, SF)).toPandas()
    ks = [0.5, 1.0, 2.0]

    def loss(rows, k):
        z = (rows["mean"] - rows["mean_b"]) / ((rows["sd"] ** 2 + rows["sd_b"] ** 2) ** 0.5 * k)
        p = z.map(lambda x: min(max(0.5 * math.erfc(-x / 2**0.5), 1e-6), 1 - 1e-6))
        return -(rows["won"] * p.map(math.log) + (1 - rows["won"]) * (1 - p).map(math.log))

    for r in catalog.queries()["p18_calibration_study"](spark, SF).collect():
        own, rest = m[m["season"] == r["season"]], m[m["season"] != r["season"]]
        best = min(ks, key=lambda k: loss(rest, k).sum())
        assert r["n"] == len(own) and r["factor"] == best and abs(r["log_loss"] - loss(own, best).mean()) < 1e-5


TESTED = {"m4_m5_ridge_by_group", "e6_season_folds", "m29_penalty_sweep", "k4_expected_poisson", "p2_playoff_probability", "p9_convolved_sides", "e11_bootstrap", "p18_calibration_study", "p10_random_deals"}


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - TESTED))
def test_query_without_sql_has_whole_rows(spark, name):
    """Rows there are, one for each key, none with a number that is not one."""
    rows = catalog.queries()[name](spark, SF).collect()
    assert rows and not [r for r in rows for v in r if isinstance(v, float) and v != v]
    assert len({tuple(map(str, r)) for r in rows}) == len(rows)


SEASONS = {"l1_lineup_by_season": "l1_best_lineup", "l3_swaps_by_season": "l3_swaps", "l29_weakest_by_season": "l29_weakest_starters", "g6_proof_by_season": "g6_proof_by_count", "u5_missing_by_season": "u5_missing_periods", "w8_role_by_season": "w8_role_labels", "w9_rank_by_season": "w9_rank_among_qualified"}


@pytest.mark.parametrize("name", sorted(SEASONS))
def test_every_season_has_rows_and_one_equals_its_query(spark, name):
    got = catalog.queries()[name](spark, SF).cache()
    want = catalog.queries()[SEASONS[name]](spark, SF)
    one = got.where("season = 1996").select(*want.columns)
    assert plain([tuple(r) for r in one.collect()], want.columns) == plain([tuple(r) for r in want.collect()], want.columns)
    assert got.select("season").distinct().count() == 7
    got.unpersist()


def test_sides_of_every_season_and_deals_of_every_rank(spark):
    from panelyard.plans.registry import Tables

    sides = catalog.queries()["p9_convolved_sides"](spark, SF).collect()
    assert len({r["matchup"] // 100 for r in sides}) == 7
    dealt = catalog.queries()["p10_random_deals"](spark, SF).groupBy("rep").sum("pts").collect()
    assert {r[1] for r in dealt} == {Tables(spark, SF).facts.groupBy().sum("pts").first()[0]}


def test_pick_grid_of_a_nation_with_more_than_two_thousand_suppliers(spark, duck, tmp_path):
    from pyspark.sql import functions as F

    spark.range(2003).select(F.col("id").alias("s_suppkey"), F.lit(4).alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{tmp_path}/supplier.parquet/*.parquet')")
    got = catalog.queries()["f22_pick_grid"](spark, str(tmp_path))
    want = con.execute(catalog.oracle_sql()["f22_pick_grid"])
    names = [d[0] for d in want.description]
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), names) and got.count() == 4 * 2003


def test_earlier_rows_alike_in_sql_by_a_join(duck):
    """The SQL against a count over pairs, on rows of few groups."""
    con = duckdb.connect()
    con.execute("CREATE TABLE customer AS SELECT k AS c_custkey, 1 AS c_nationkey, 'A' AS c_mktsegment FROM range(400) r(k)")
    con.execute("CREATE TABLE orders AS SELECT k * 400 + m AS o_orderkey, m AS o_custkey, DATE '1998-01-15' + to_months((k * 7 + m % 5)::INT) AS o_orderdate FROM range(20) r(k), range(400) q(m)")
    con.execute("CREATE TABLE lineitem AS SELECT o_orderkey AS l_orderkey, 1.0 AS l_quantity, 1.0 AS l_extendedprice, 'N' AS l_returnflag FROM orders")
    got = con.execute(catalog.oracle_sql()["j14_earlier_rows_alike"]).fetchall()
    want = con.execute("WITH f AS (SELECT o_custkey AS entity, (year(o_orderdate) * 12 + month(o_orderdate))::INT AS t FROM orders) SELECT a.entity, a.t, count(b.t) FROM f a LEFT JOIN f b ON b.t < a.t GROUP BY ALL").fetchall()
    assert sorted(got) == sorted(want) and len(got) == 8000
