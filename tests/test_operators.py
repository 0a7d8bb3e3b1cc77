import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.functions import scalars as S
from panelyard.operators import allocation, changes, estimators, evaluation, features, identity, market, panels, probability, quality, scored
from panelyard.sources import tables


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


# ---- semantics that are easy to get wrong


def test_last_label_skips_nulls(spark):
    df = spark.createDataFrame([(1, 1, "a", 2), (1, 2, None, 3), (2, 1, None, 1)], "e int, p int, team string, x int")
    got = panels.season_to_date(df, ["e"], "p", F.lit(9), ["x"], ["team"])
    assert rows(got, "e", "team", "x_sum", "x_rate") == [(1, "a", 5, 2.5), (2, None, 1, 1.0)]


def test_as_of_is_strict_and_equal_periods_do_not_leak(spark):
    left = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (1, None)], "k int, p int")
    right = spark.createDataFrame([(1, 5, 10), (1, 3, 7), (1, 3, 8), (2, 9, 1), (1, None, 99)], "k int, p int, v int")
    assert rows(panels.asof_join(left, right, ["k"], "p", ["v"]).na.fill(-1)) == [(1, -1, -1), (1, 5, 8), (1, 6, 10), (2, 5, -1)]
    assert rows(panels.asof_join(left, right, ["k"], "p", ["v"], strict=False).na.fill(-1)) == [(1, -1, -1), (1, 5, 10), (1, 6, 10), (2, 5, -1)]


def test_ratio_of_nothing_is_null(spark):
    df = spark.createDataFrame([(1, 0), (1, 2), (1, None)], "n int, d int").select(S.safe_ratio(F.col("n"), F.col("d")).alias("r"))
    assert sorted(str(r[0]) for r in df.collect()) == ["0.5", "None", "None"]


def test_ewm_matches_pandas(spark):
    import pandas as pd

    xs = [3.0, None, 5.0, 1.0, None, 8.0]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(xs)], "e int, p int, x double")
    want = pd.Series(xs).ewm(halflife=1, ignore_na=True).mean().iloc[-1]
    assert panels.ewm_mean(df, ["e"], "p", "x").first()["x_ewm"] == pytest.approx(want)


def test_interpolation_is_that_of_numpy(spark):
    curve = spark.createDataFrame([("a", 1, 10.0), ("a", 3, 4.0), ("a", 7, 0.0)], "c string, r int, v double")
    at = [0.5, 1.0, 2.0, 3.0, 5.0, 9.0]
    pts = spark.createDataFrame([("a", x) for x in at], "c string, q double")
    got = dict(rows(panels.interpolate(pts, curve, ["c"], "r", "v", "q"), "q", "interpolated"))
    assert [got[x] for x in at] == pytest.approx(np.interp(at, [1, 3, 7], [10, 4, 0]).tolist())


def test_features_do_not_leak(spark):
    df = spark.createDataFrame([(e, g % 2, 1, p, 1, (e * 7 + p * 3) % 11 + 1) for e, g in ((1, 0), (2, 0), (3, 1)) for p in range(1, 9)], "e int, g int, season int, p int, one int, x int")
    for build in (
        lambda f: features.core(f, "e", "season", "p", ["x"]),
        lambda f: features.share_history(f, "e", "g", "season", "p", "x"),
        lambda f: features.role_change(f, "e", "g", "p", "x"),
        lambda f: features.newcomers(f, "e", "g", "p"),
        lambda f: features.absence_ramp(f, "e", "g", "p"),
        lambda f: features.opponent_relative(f, "g", "season", "p", "x", "one"),
    ):
        assert features.leak_rows(build, df, "p", 5, ["p"]).count() == 0
    peek = lambda f: f.withColumn("y", F.max("x").over(__import__("pyspark").sql.Window.partitionBy("e")))
    assert features.leak_rows(peek, df, "p", 2, ["p"]).count() > 0


# ---- scalars


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert [get(S.normalize_id(F.lit(v))) for v in (" 00-0035057", "1234.0", "nan", "", None)] == ["00-0035057", "1234", "", "", ""]
    assert get(S.name_key(F.lit("José O'Néill Jr."))) == "joseoneill"
    assert [get(S.count_in_text(F.lit(v), "TE")) for v in ("1 RB, 2 TE", "3 WR", None)] == [2, 0, None]
    assert [tuple(t) for t in get(S.parse_tokens(F.lit("7:KC:12.3 8:SF:4")))] == [(7, "KC", 12.3), (8, "SF", 4.0)]
    assert get(S.split_list(F.lit("a; b;;c"))) == ["a", "b", "c"]
    assert [get(S.implied_probability(F.lit(p))) for p in (100, 150, -150, 50)] == [0.5, 0.4, 0.6, None]
    for z in (-3.0, -0.4, 0.0, 1.3):
        assert get(S.normal_cdf(F.lit(z))) == pytest.approx((1 + math.erf(z / math.sqrt(2))) / 2, abs=1e-13)
    assert get(S.win_probability(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))) == 1.0
    e = 1e-5
    base = lambda m, s: get(S.win_probability(F.lit(m), F.lit(s), F.lit(100.0), F.lit(20.0)))
    assert get(S.leverage(F.lit(104.0), F.lit(22.0), F.lit(100.0), F.lit(20.0))) == pytest.approx((base(104 + 1e-2, 22.0) - base(104 - 1e-2, 22.0)) / 2e-2, rel=1e-2)
    assert get(S.spread_effect(F.lit(90.0), F.lit(22.0), F.lit(100.0), F.lit(20.0))) > 0 > get(S.spread_effect(F.lit(110.0), F.lit(22.0), F.lit(100.0), F.lit(20.0))) and e
    want = sum(math.exp(-2.5) * 2.5**k / math.factorial(k) for k in range(4))
    assert get(S.poisson_cdf(F.lit(3), F.lit(2.5))) == pytest.approx(want)
    assert str(get(S.local_to_utc(F.lit("2026-09-13"), F.lit("13:00")))) == "2026-09-13 17:00:00" and str(get(S.local_to_utc(F.lit("2026-12-13"), F.lit("13:00")))) == "2026-12-13 18:00:00"
    assert get(S.zone_offset_hours(F.to_timestamp(F.lit("2026-07-01")), "America/New_York")) == -4
    assert [get(S.season_of(F.to_date(F.lit(d)))) for d in ("2026-01-05", "2026-09-05")] == [2025, 2026]
    assert get(S.clock_elapsed(F.lit(5), F.lit(120))) == 4080 and get(S.clock_elapsed(F.lit(2), F.lit(2000))) == 1600
    picks = {get(S.snake_pick(F.lit(s), F.lit(r), 4)) for s in range(1, 5) for r in range(1, 4)}
    assert picks == set(range(1, 13))
    assert get(S.survival(F.lit(20), F.lit(10), F.lit(15.0))) <= 1
    a, b = S.beta_moments(F.lit(0.3), F.lit(0.01))
    assert get(a) / (get(a) + get(b)) == pytest.approx(0.3)


# ---- sources


def test_csv_spellings_of_missing(spark, tmp_path):
    (tmp_path / "x.csv").write_text("ID,Score\n1,2.5\n2,NA\n3,\n4,bad\nNaN,7\n")
    got = tables.read_csv(spark, f"{tmp_path}/x.csv", "id int, score double, absent string")
    assert [tuple(r) for r in got.collect()] == [(1, 2.5, None), (2, None, None), (3, None, None), (4, None, None), (None, 7.0, None)]
    good, why = tables.import_with_reasons(spark.read.csv(f"{tmp_path}/x.csv", header=True), ["Score"], ["Score"])
    assert good.count() == 3 - 1 and rows(why) == [("Score is missing", 1), ("Score is not a number", 2)]


def test_drifting_columns_and_codes(spark):
    a = spark.createDataFrame([("REG", "OAK"), ("POST", "KC")], "season_type string, team string")
    b = spark.createDataFrame([("REG", "SD")], "game_type string, team string")
    both = tables.regular_rows(a.unionByName(b, allowMissingColumns=True))
    assert rows(tables.normalize_codes(both, ["team", "not_there"], {"OAK": "LV", "SD": "LAC"}), "team") == [("LAC",), ("LV",)]
    gaps = tables.scoring_gaps(spark, ["a", "b"], {"x": ["a"], "y": ["b", "c"], "z": ["d"]})
    assert rows(gaps, "term", "gap") == [("y", "partial"), ("z", "absent")]


def test_nested_payloads(spark, tmp_path):
    doc = '{"id":"g1","home_team":"A","away_team":"B","bookmakers":[{"key":"bk","markets":[{"key":"yards","outcomes":[{"name":"over","description":"P","price":-110.0,"point":50.5},{"name":"under","description":"P","price":-110.0,"point":50.5},{"name":"draw","description":"P","price":100.0},{"name":"over","description":"","price":100.0}]}]}]}'
    (tmp_path / "p.json").write_text(doc)
    schema = "id string, home_team string, away_team string, bookmakers array<struct<key string, markets array<struct<key string, outcomes array<struct<name string, description string, price double, point double>>>>>>"
    docs = tables.read_documents(spark, f"{tmp_path}/p.json", schema)
    quotes, unusable = tables.flatten_prop_payload(docs)
    assert rows(unusable) == [("no player", 1), ("unknown side", 1)]
    main, _ = market.devig(quotes)
    assert rows(main, "player", "point", "p_over", "method") == [("P", 50.5, 0.5, "two-way")]
    assert rows(tables.record_files(docs, r"(\w)\.json"), "stamp") == [("p",)]
    yes = spark.createDataFrame([("g1", "bk", 200.0), ("g1", "other", 200.0)], "event_id string, book string, price double")
    got = dict(rows(market.one_sided(yes, main), "book", "p_yes"))
    assert got["other"] is None and got["bk"] == pytest.approx((1 / 3) / (1 + 2 * 110 / 210 - 1))


def test_price_history_and_rosters(spark):
    h = spark.createDataFrame([("f1", {"bk": {"markets": {"m": {"outcomes": {"o": {"players": {"p": [{"createdAt": "2026-01-01T00:00:00Z", "price": 1.9}, {"createdAt": "2026-01-01T01:00:00Z", "price": 2.0}]}}}}}}})], "fixture string, bookmakers map<string, struct<markets: map<string, struct<outcomes: map<string, struct<players: map<string, array<struct<createdAt: string, price: double>>>>>>>>>")
    assert rows(tables.flatten_price_history(h, ["fixture"]), "book", "market", "outcome", "player", "price") == [("bk", "m", "o", "p", 1.9), ("bk", "m", "o", "p", 2.0)]
    s = spark.createDataFrame([("L", 3, [{"roster_id": 1, "starters": ["a", "b"], "players": ["b", "c", "a"]}])], "league_id string, week int, rosters array<struct<roster_id: int, starters: array<string>, players: array<string>>>")
    assert {r["player_id"]: r["slot"] for r in tables.flatten_rosters(s).collect()} == {"a": 0, "b": 1, "c": None}
    t = spark.createDataFrame([("waiver", "complete", 1000, {"x": 1}, {"y": 1}, {"waiver_bid": 7}), ("waiver", "failed", 2000, {"z": 1}, None, None)], "type string, status string, created long, adds map<string, int>, drops map<string, int>, settings struct<waiver_bid: int>")
    got = tables.flatten_transactions(t)
    assert rows(got, "player_id", "action", "bid") == [("x", "add", 7), ("y", "drop", 7)]
    assert allocation.latest_drop(got, "player_id", "at").count() == 1


def test_depth_charts_of_both_layouts(spark):
    weekly = spark.createDataFrame([(2026, 1, "A", "QB", "p", "1")], "season int, week int, team string, depth_position string, gsis_id string, depth_team string")
    assert rows(tables.flatten_charts(weekly)) == [(2026, 1, "A", "QB", "p", 1)]
    dated = spark.createDataFrame([("A", datetime(2026, 9, 1), "QB", "old", 1), ("A", datetime(2026, 9, 10), "QB", "new", 1), ("A", datetime(2026, 9, 14), "QB", "late", 1)], "team string, dt timestamp, pos_abb string, gsis_id string, pos_rank int")
    kick = spark.createDataFrame([(2026, 1, "A", datetime(2026, 9, 13))], "season int, week int, team string, kickoff timestamp")
    assert rows(tables.flatten_charts(dated, kick), "gsis_id") == [("new",)]


def test_snapshots_upserts_and_series(spark, tmp_path):
    df = spark.createDataFrame([(1, 2026, 5.0)], "id int, season int, v double")
    tables.append_snapshot(df, f"{tmp_path}/t", ["season"])
    tables.append_snapshot(df, f"{tmp_path}/t", ["season"])
    back = spark.read.parquet(f"{tmp_path}/t")
    assert back.count() == 2 and back.select("digest").distinct().count() == 1
    assert rows(tables.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    s = spark.createDataFrame([("v", [1, 2], [3.0, None])], "venue string, time array<int>, wind array<double>")
    assert [tuple(r) for r in tables.flatten_series(s, ["venue"], ["time", "wind"]).collect()] == [("v", 1, 3.0), ("v", 2, None)]
    games = spark.createDataFrame([(2026, 1, "REG", "2026-09-13", "13:00"), (2026, 1, "REG", "2026-09-13", "TBD"), (2026, 1, "POST", "2026-09-13", "13:00")], "season int, week int, game_type string, gameday string, gametime string")
    timed, untimed = tables.game_calendar(games)
    assert timed.count() == 1 and rows(untimed, "untimed") == [(1,)]
    ranks = spark.createDataFrame([("a", "QB", 1, datetime(2026, 8, 1)), ("a", "QB", 2, datetime(2026, 8, 30)), ("a", "QB", 9, datetime(2026, 8, 30)), ("b", "QB", 3, datetime(2026, 8, 30)), ("c", "RB", 1, datetime(2026, 8, 30)), ("d", "QB", 1, datetime(2026, 9, 9))], "id string, category string, rank int, scraped timestamp")
    assert rows(tables.ranking_as_of(ranks, F.to_timestamp(F.lit("2026-09-05")), 30, {"QB": 1, "RB": 2}), "id", "rank") == [("a", 2), ("c", 1)]


# ---- scores


def test_scoring_rules(spark):
    df = spark.createDataFrame([("QB", 300.0, 2.0, 1.0, 5.0, None), ("K", None, None, None, None, 3.0)], "position string, passing_yards double, passing_tds double, interceptions double, rushing_yards double, fg_made_40_49 double")
    got = [r["p"] for r in df.select(scored.routed_score(df.columns).alias("p")).collect()]
    assert got == pytest.approx([300 * 0.04 + 8 - 1 + 0.5, 12.0])
    tiers = spark.createDataFrame([(0.0,), (6.0,), (7.0,), (35.0,), (None,)], "a double").select(scored.defense_score([], F.col("a")).alias("p"))
    assert [r["p"] for r in tiers.collect()] == [10.0, 7.0, 4.0, -4.0, None]


def test_plays_credit_all_who_made_them(spark):
    p = spark.createDataFrame([("g", 1, "q", None, "w", 20.0, 1.0, 0.0, None, None, 1.0, 20.0), ("g", 2, None, "r", None, None, None, None, 7.0, 0.0, None, None)], "game_id string, play_id int, passer_id string, rusher_id string, receiver_id string, passing_yards double, pass_touchdown double, interception double, rushing_yards double, rush_touchdown double, complete_pass double, receiving_yards double")
    assert {r["entity"]: round(r["points"], 6) for r in scored.credits(p).collect()} == {"q": 4.8, "w": 8.5, "r": 0.7}


def test_availability_and_player_weeks(spark):
    players = spark.createDataFrame([(1, 1, "A", "x"), (1, 1, "A", "y"), (1, 1, "B", "z"), (1, 1, "A", "w")], "season int, week int, team string, player_id string")
    rosters = spark.createDataFrame([(1, 1, "A", "x"), (1, 1, "A", "w")], "season int, week int, team string, player_id string")
    reports = spark.createDataFrame([(1, 1, "x", "Questionable"), (1, 1, "w", "Questionable"), (1, 1, "w", "Out")], "season int, week int, player_id string, report_status string")
    got = {r["player_id"]: r["availability"] for r in scored.availability(players, rosters, reports).collect()}
    assert got == {"x": "questionable", "y": "out", "z": None, "w": "out"}
    weekly = spark.createDataFrame([("x", 1, 1, "WR", 5.0, None), ("y", 1, 1, "WR", None, None)], "player_id string, season int, week int, position string, targets double, carries double")
    snaps = spark.createDataFrame([("x", 1, 1, 40.0, 0.6)], "player_id string, season int, week int, offense_snaps double, offense_pct double")
    assert {r["player_id"]: (r["opportunities"], r["offense_snaps"]) for r in scored.player_weeks(weekly, snaps).collect()} == {"x": (5.0, 40.0), "y": (None, None)}
    flags = scored.practice_flags(spark.createDataFrame([("Out", "Did Not Participate"), (None, "Limited")], "report_status string, practice_status string"))
    assert [(r["is_out"], r["did_not_practice"], r["limited"]) for r in flags.collect()] == [(1, 1, 0), (0, 0, 1)]


# ---- estimators


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 3)) * [1, 5, 0.2] + [0, 3, 9]
    y = x @ [1.0, -0.5, 4.0] + rng.normal(size=80)
    df = spark.createDataFrame([("g", int(k % 4), *map(float, x[k]), float(y[k])) for k in range(80)], "g string, season int, a double, b double, c double, y double")
    sd = x.std(axis=0, ddof=1)
    z = (x - x.mean(axis=0)) / sd
    beta = np.linalg.solve(z.T @ z + 5 * np.eye(3), z.T @ (y - y.mean()))
    params = estimators.ridge_fit(df, ["g"], ["a", "b", "c"], "y")
    got = {r["col"]: r["beta"] for r in params.collect()}
    assert [got[c] for c in "abc"] == pytest.approx(beta.tolist()) and got["(1)"] == pytest.approx(y.mean())
    pred = [r["predicted"] for r in estimators.ridge_predict(df, params, ["g"], ["a", "b", "c"]).orderBy("a").collect()]
    assert pred == pytest.approx((z @ beta + y.mean())[np.argsort(x[:, 0])].tolist())
    folds = estimators.season_folds(df, ["g"], "season", ["a", "b", "c"], "y")
    for s in range(4):
        t = np.arange(80) % 4 != s
        m, d = x[t].mean(axis=0), x[t].std(axis=0, ddof=1)
        b = np.linalg.solve(((x[t] - m) / d).T @ ((x[t] - m) / d) + 5 * np.eye(3), ((x[t] - m) / d).T @ (y[t] - y[t].mean()))
        want = (x[~t] - m) / d @ b + y[t].mean()
        assert sorted(r["predicted"] for r in folds.where(F.col("season") == s).collect()) == pytest.approx(sorted(want.tolist()))


def test_median_line_is_near_the_truth(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 10, 300)
    y = 2 + 1.5 * x + rng.standard_t(1.5, 300)
    a, b = estimators.median_line(spark.createDataFrame([(float(p), float(q)) for p, q in zip(x, y, strict=True)], "x double, y double"), "x", "y", rounds=40)
    loss = lambda a, b: np.abs(y - a - b * x).sum()
    assert loss(a, b) <= min(loss(a + da, b + db) for da in (-0.1, 0, 0.1) for db in (-0.02, 0, 0.02)) + 0.05


# ---- probabilities


def test_distributions(spark):
    df = spark.createDataFrame([([0.5, 0.6, 0.7],)], "ps array<double>")
    pmf = df.select(probability.poisson_binomial(F.col("ps")).alias("p"))
    assert pmf.first()["p"] == pytest.approx([0.06, 0.29, 0.44, 0.21])
    assert pmf.select(probability.at_least(F.col("p"), 2).alias("x")).first()["x"] == pytest.approx(0.65)
    d = spark.createDataFrame([([0.2, 0.5, 0.3],)], "p array<double>").select(probability.lattice_crps(F.col("p"), F.lit(0), 1, F.lit(1.0)).alias("c"), probability.lattice_quantile(F.col("p"), F.lit(0), 1, 0.6).alias("q")).first()
    assert d["c"] == pytest.approx(0.2**2 + 0.3**2) and d["q"] == 1
    n = spark.range(1).select(probability.discretised_normal(F.lit(5.0), F.lit(2.0), 0, 10).alias("p")).first()["p"]
    assert sum(n) == pytest.approx(1) and n[5] == pytest.approx(math.erf(0.25 / math.sqrt(2)), abs=1e-6)
    s = spark.createDataFrame([(1, 0, [0.5, 0.5]), (1, 0, [0.0, 1.0]), (1, 1, [0.25, 0.5, 0.25])], "m int, s int, pmf array<double>")
    assert probability.beats(probability.convolved(s, "m", "s", "pmf"), "m", "s").first()["p_a"] == pytest.approx(0.5 * (0.25 + 0.25) + 0.5 * (0.75 + 0.125))


def test_live_probability_and_abstention(spark):
    rows_ = [(1, 0, 0, 10.0, 15.0, 0.5, 3.0, 0.3, 1.0), (1, 1, 0, 12.0, 14.0, 0.25, 3.0, 0.3, 1.0)]
    df = spark.createDataFrame(rows_, "m int, s int, at int, now double, proj double, f double, a double, b double, g double")
    p = probability.live_win_probability(df, "m", "s", "at").first()["p_a"]
    sa, sb = 0.5**0.5 * (3 + 4.5), 0.25**0.5 * (3 + 4.2)
    assert p == pytest.approx((1 + math.erf((10 + 7.5 - 12 - 3.5) / math.hypot(sa, sb) / math.sqrt(2))) / 2, abs=1e-6)
    gap = spark.createDataFrame([(1, 0, 5.0, 1.0), (1, 1, None, 1.0), (1, 1, 4.0, 1.0)], "m int, s int, mean double, sd double")
    r = probability.matchups(gap, "m", "s", "mean", "sd").first()
    assert r["p_a"] is None and r["reason"].startswith("1 starters")


def test_expected_stats_invert_their_tails(spark):
    df = spark.createDataFrame([(4.5, 0.4), (4.5, 0.99)], "line double, p double")
    got = [r["m"] for r in df.select(market.expected_poisson(F.col("line"), F.col("p")).alias("m")).collect()]
    tail = 1 - sum(math.exp(-got[0]) * got[0] ** k / math.factorial(k) for k in range(5))
    assert tail == pytest.approx(0.4, abs=1e-6) and got[1] is None
    g = market.expected_gamma(spark.createDataFrame([(50.0, 0.5, 1.0), (50.0, 0.99, 1.0)], "line double, p double, k double"), "line", "p", "k").collect()
    assert g[0]["expected"] == pytest.approx(50 / math.log(2), rel=1e-3) and g[1]["expected"] is None


def test_pairwise_at_scale_equals_pairs(spark):
    rng = np.random.default_rng(4)
    data = [(int(k % 3), k, float(rng.integers(0, 12)), float(rng.integers(0, 9))) for k in range(240)]
    df = spark.createDataFrame(data, "g int, e int, p double, y double")
    got = {r["g"]: (r["pairs"], r["right"]) for r in evaluation.pairwise(df, "p", "y", ["g"], levels=10).collect()}
    for g in range(3):
        part = [(p, y) for h, _, p, y in data if h == g]
        pairs = [(a, b) for i, a in enumerate(part) for b in part[:i] if a[1] != b[1]]
        assert got[g] == (len(pairs), sum((a[0] - b[0]) * (a[1] - b[1]) > 0 for a, b in pairs))


def test_bootstrap_is_reproducible_and_covers(spark):
    df = spark.createDataFrame([(k % 30, float(k % 7)) for k in range(600)], "c int, x double")
    a, b = (evaluation.bootstrap(df, ["c"], F.col("x"), 100).first() for _ in range(2))
    assert a == b and a["q05"] < df.agg(F.avg("x")).first()[0] < a["q95"]


# ---- decisions, changes, quality


def test_moves(spark):
    lu = spark.createDataFrame([(1, "RB", "a", 10.0, "RB"), (1, "RB", "b", 6.0, "FLEX"), (1, "RB", "c", 2.0, None), (1, "QB", "q", 15.0, "QB")], "r int, cat string, e string, v double, slot string")
    pool = spark.createDataFrame([("RB", "x", 8.0), ("QB", "y", 14.0)], "cat string, e string, v double")
    got = {r["add"]: (r["gain"], r["slot"], r["sits"], r["drop"], r["verdict"]) for r in allocation.add_drop_board(pool, lu, ["r"], "cat", "v", "e", ["RB"]).collect()}
    assert got == {"x": (2.0, "FLEX", "b", "c", "starts"), "y": (-1.0, "QB", "q", "c", "depth")}
    now = F.to_timestamp(F.lit("2026-09-13 18:00:00"))
    locks = spark.createDataFrame([("a", datetime(2026, 9, 13, 17), 1, False), ("b", datetime(2026, 9, 14), 1, False), ("c", None, 0, True), ("d", None, 0, False), ("e", None, 2, False)], "t string, k timestamp, n int, off boolean")
    assert {r["t"]: r["lock"] for r in allocation.lock_state(locks, "k", "n", now, "off").collect()} == {"a": "LOCKED", "b": "OPEN", "c": "OPEN", "d": "UNKNOWN", "e": "UNKNOWN"}
    gates = allocation.gate(spark.createDataFrame([("swap",), ("add",)], "action string"), spark.createDataFrame([("swap", "s1"), ("add", "s1"), ("add", "s2")], "action string, source string"), spark.createDataFrame([("s1", "FRESH", 5)], "source string, state string, expires int"))
    assert rows(gates, "action", "allowed", "blocked_by") == [("add", False, "s2"), ("swap", True, "")]
    slots = allocation.slots_of(spark.createDataFrame([(1, ["a", "b", "c"])], "r int, st array<string>"), ["r"], "st", ["QB", "RB"])
    assert [(r["entity"], r["slot"]) for r in slots.collect()] == [("a", "QB"), ("b", "RB"), ("c", None)]


def test_identity(spark):
    x = spark.createDataFrame([("n1",), ("n2",), ("n3",)], "name string")
    known = spark.createDataFrame([("n1", 1), ("n1", 1), ("n2", 2), ("n2", 3)], "name string, id int")
    assert rows(identity.resolve_exact(x, known, "name", "id"), "name", "basis") == [("n1", "exact"), ("n2", "ambiguous"), ("n3", "unresolved")]
    assert {r["status"]: r["n"] for r in identity.resolution_report(x, known, "name", "id").collect()} == {"mapped": 2, "unresolved": 1}
    with pytest.raises(Exception, match="repeats"):
        identity.one_to_one(x, known, "name").collect()
    games = spark.createDataFrame([("d", "B", "A", 7), ("e", "A", "B", 8), ("e", "B", "A", 9)], "day string, h string, a string, gid int")
    seen = spark.createDataFrame([("d", "A", "B"), ("e", "A", "B")], "day string, h string, a string")
    assert [r["gid"] for r in identity.match_pairs(seen, games, "day", "h", "a", "gid").orderBy("day").collect()] == [7, None]
    own = identity.ownership(x, spark.createDataFrame([("n1", 1), ("n2", 2)], "name string, o int"), "name", "o", 1)
    assert rows(own, "name", "ownership") == [("n1", "MINE"), ("n2", "ROSTERED"), ("n3", "FREE")]


def test_changes(spark):
    a = spark.createDataFrame([(1, {"x": "1", "y": "2"})], "k int, s map<string, string>")
    b = spark.createDataFrame([(1, {"x": "1", "y": "3", "z": "4"})], "k int, s map<string, string>")
    assert rows(changes.settings_diff(a, b, "k", "s"), "setting", "change") == [("y", "changed"), ("z", "set")]
    c = changes.comparable(spark.createDataFrame([(1, 2)], "w int, l int"), spark.createDataFrame([(1, 3)], "w int, l int"), ["w", "l"]).first()
    assert not c["comparable"] and c["differs"] == ["l"]
    s = changes.source_stamps(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "source string, as_of int"), spark.createDataFrame([("a", 2), ("b", 1)], "source string, as_of int"))
    assert rows(s) == [("a", "refreshed"), ("b", "older"), ("c", "missing")]


def test_quality(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (None, 3)], "a int, b int")
    good, bad = quality.validate(df, {"a known": F.col("a").isNotNull(), "b large": F.col("b") > 4})
    assert rows(good) == [(2, 5)] and sorted(r["reasons"] for r in bad.collect()) == [["a known", "b large"], ["b large"]]
    assert rows(quality.repeated_keys(spark.createDataFrame([(1,), (1,), (2,)], "k int"), ["k"])) == [(1, 2)]
    f = quality.filed(spark.createDataFrame([(1, "A"), (1, "B")], "w int, g string"), spark.createDataFrame([(1, "A")], "w int, g string"), ["w"], "g")
    assert rows(f) == [(1, "A", True), (1, "B", False)]


def test_season_wins_count_every_month_of_an_entity(spark):
    from types import SimpleNamespace

    from panelyard.plans import model_queries

    facts = spark.createDataFrame([(1, 0)] * 40 + [(1, 50)] * 3, "entity long, qty long")
    got = model_queries.p2(SimpleNamespace(facts=facts)).first()
    assert got["cells"] == 44 and abs(got["three_or_more"] - 0.125) < 1e-9


def test_pairs_over_a_gap_equal_brute_force_in_every_season(spark):
    from panelyard.plans import report_queries

    rng = np.random.default_rng(4)
    data = [(e, "c", int(t), float(rng.integers(0, 12) * 50), float(rng.integers(0, 8)), float(rng.integers(0, 30))) for t in (1, 2, 3) for e in range(23)]
    df = spark.createDataFrame(data, "entity long, cat string, t int, actual double, sys_mean double, sys_eb double")
    got = {r["attribute"]: (r["pairs"], r["sys_mean"], r["sys_eb"]) for r in report_queries.pairs_by_gap(df, ["sys_mean", "sys_eb"], 200).collect()}
    for over in (True, False):
        pairs = [(a, b) for a in data for b in data if a[2] == b[2] and a[3] < b[3] and (b[3] - a[3] > 200) == over]
        assert got[over] == (len(pairs), *[pytest.approx(sum(a[k] < b[k] for a, b in pairs) / len(pairs)) for k in (4, 5)])


def test_playoff_probability_and_leverage(spark):
    df = spark.createDataFrame([(k,) for k in (-1, 0, 1, 2, 3, 4)], "k int").withColumn("pmf", probability.poisson_binomial(F.array(F.lit(0.5), F.lit(0.2))))
    got = rows(df, "k", probability.playoff_probability(F.col("pmf"), F.lit(0.3), F.col("k")), probability.playoff_leverage(F.col("pmf"), F.col("k")))
    want = [(-1, 1.0, 0.0), (0, 1.0, 0.0), (1, 0.72, 0.4), (2, 0.25, 0.5), (3, 0.03, 0.1), (4, 0.0, 0.0)]
    assert [r[0] for r in got] == [w[0] for w in want]
    assert [v for r in got for v in r[1:]] == pytest.approx([v for w in want for v in w[1:]])


# ---- lattices


def test_long_lattices_are_worked_out_once_a_cell(spark):
    import time

    rng = np.random.default_rng(3)
    counts, rest, pmf = rng.dirichlet(np.ones(40)), rng.dirichlet(np.ones(300)), rng.dirichlet(np.ones(300))
    df = spark.createDataFrame([(counts.tolist(), rest.tolist(), pmf.tolist(), float(m)) for m in (-40.3, 150.25, 155.0, 420.5)], "counts array<double>, rest array<double>, pmf array<double>, mean double").repartition(4)
    start = time.time()
    got = df.select("mean", probability.compound_lattice(F.reverse(F.reverse("counts")), 6, F.col("rest")).alias("sums"), probability.regridded(F.reverse(F.reverse("pmf")), F.col("mean")).alias("moved")).collect()
    assert time.time() - start < 20
    far = np.zeros((39 * 6 + 300))
    for k, p in enumerate(counts):
        far[6 * k : 6 * k + 300] += p * rest
    for r in got:
        assert np.allclose(r["sums"], far, atol=1e-12)
        move = r["mean"] - (pmf * np.arange(300)).sum()
        want, whole = np.zeros(300), math.floor(move)
        for k, p in enumerate(pmf):
            want[min(max(k + whole, 0), 299)] += p * (1 - (move - whole))
            want[min(max(k + whole + 1, 0), 299)] += p * (move - whole)
        assert np.allclose(r["moved"], want, atol=1e-12)


def test_counts_that_leave_gaps_and_a_lattice_of_one_cell(spark):
    one = spark.range(1).select(probability.compound_lattice(F.array(F.lit(0.5), F.lit(0.5)), 3, F.array(F.lit(1.0))).alias("g"), probability.regridded(F.array(F.lit(1.0)), F.lit(2.5)).alias("r"), probability.poisson_lattice(F.lit(2.0), 0).alias("p"), probability.discretised_normal(F.lit(0.0), F.lit(1.0), 3, 3).alias("d")).first()
    assert one["g"] == [0.5, 0.0, 0.0, 0.5] and one["r"] == [1.0] and one["d"] == [1.0] and one["p"] == pytest.approx([1.0])


def test_both_readings_of_ranged_rows_share_their_cuts(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), (F.col("id") % 1237).alias("v"), "id")
    for out in (panels.ranks(df, ["g"], F.col("v"), "r"), panels.running_sums(df, ["g"], F.col("v"), ["id"], {"s": F.col("id")})):
        # Approximate cuts hang on the order in which partial results arrive: worked out in each branch they may differ.
        assert "percentile_approx" not in out._jdf.queryExecution().toString()
    got = panels.ranks(df, ["g"], F.col("v"), "r").toPandas()
    assert (got["r"] == got.groupby("g")["v"].rank(method="min")).all()
