from datetime import datetime

import pytest
from pyspark.sql import functions as F

from panelyard.operators import blocks


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_feeds_and_scores(spark):
    feed = spark.createDataFrame([("e", "A", 1, 100.0, datetime(2026, 9, 1))], "entity string, team string, week int, rush_yds double, as_of timestamp")
    kick = spark.createDataFrame([("A", 1, datetime(2026, 9, 13))], "team string, week int, kickoff timestamp")
    assert rows(blocks.projection_feed(feed, {"rush_yds": "rushing_yards"}, kick), "points", "in_time") == [(10.0, True)]
    s = blocks.expected_share(spark.createDataFrame([("a", "A", 30.0), ("b", "A", 10.0)], "e string, team string, x double"), {"x": "rushing_yards"}, "team", [])
    assert rows(s, "e", "expected_share") == [("a", 0.75), ("b", 0.25)]
    df = spark.createDataFrame([(100.0, 20.0, 4.0)], "passing_yards double, rushing_yards double, receptions double")
    assert df.select(*[c.alias(n) for n, c in blocks.component_points(df.columns).items()]).first().asDict() == {"pass_points": 4.0, "rush_points": 2.0, "receive_points": 2.0}
    plays = spark.createDataFrame([(1, 1, "g", "field_goal", "A", "B", "made", 44, None, None, 0), (1, 1, "g", "punt", "A", "B", None, 50, 12, None, 0), (1, 1, "g", "pass", "A", "B", None, None, None, "success", 1)], "season int, week int, game_id string, play_type string, posteam string, defteam string, field_goal_result string, kick_distance int, return_yards int, two_point_conv_result string, two_point_attempt int")
    assert rows(blocks.special_events(plays), "kind", "team", "value") == [("field_goal", "A", 1.0), ("punt_return", "B", 12.0), ("try", "A", 1.0)]


def test_team_and_passer_features(spark):
    tw = spark.createDataFrame([("A", 1, 1, 10.0), ("B", 1, 1, 20.0), ("A", 1, 2, 30.0)], "team string, season int, week int, pts double")
    sched = spark.createDataFrame([("A", "B", 1, 3), ("A", "B", 1, 1)], "team string, opponent string, season int, week int")
    got = {r["week"]: (r["pts_mean"], r["opp_pts_mean"]) for r in blocks.own_and_opponent(tw, sched, "season", "week", ["pts"]).collect()}
    assert got == {1: (None, None), 3: (20.0, 20.0)}
    starters = spark.createDataFrame([("A", 1, w, q) for w, q in ((1, "p"), (2, "q"), (3, "p"))], "team string, season int, week int, passer string")
    catches = spark.createDataFrame([("w", "A", 1, 1, "p", 6, 20), ("w", "A", 1, 2, "q", 2, 20), ("w", "A", 1, 3, "p", 1, 10)], "entity string, team string, season int, week int, passer string, own int, team_n int")
    q = {r["week"]: r for r in blocks.quarterback_change(starters, catches, "season", "week").collect()}
    assert q[3]["changed"] and q[3]["games_with"] == 1 and q[3]["share_delta"] == pytest.approx(6 / 20 - 8 / 40)


def test_rates_and_priors(spark):
    df = spark.createDataFrame([("a", 1, 1, 3, 10), ("b", 1, 1, 1, 10), ("a", 1, 2, 5, 10)], "e string, season int, week int, made int, n int")
    r = {(x["e"], x["week"]): x["over"] for x in blocks.rate_over_expectation(df, ["e"], "season", "week", "made", "n", 10.0).collect()}
    assert r[("a", 2)] == pytest.approx((3 - 10 * 4 / 20) / 20) and r[("a", 1)] is None
    ev = blocks.evidence(spark.createDataFrame([("a", "A", "WR", 1, 6), ("b", "A", "WR", 1, 2), ("a", "A", "WR", 2, 9)], "e string, g string, c string, p int, x int"), "e", "g", "c", "p", 1, "x")
    assert rows(ev, "e", "share", "role") == [("a", 0.75, "WR1"), ("b", 0.25, "WR2")]
    s = blocks.parameter_search(spark.createDataFrame([(1.0,), (3.0,)], "y double"), [{"m": 0.0}, {"m": 2.0}], lambda g: F.abs(F.col("y") - g["m"])).first()
    assert (s["m"], s["score"]) == (2.0, 1.0)


def test_matchups_and_calibration(spark):
    st = spark.createDataFrame([(1, "m", 0, 10.0, 3.0, 12.0), (1, "m", 1, 8.0, 4.0, 9.0), (2, "n", 0, None, 1.0, 3.0), (2, "n", 1, 5.0, 1.0, 3.0), (3, "o", 0, 5.0, 1.0, 3.0)], "season int, m string, side int, projection double, spread double, actual double")
    good, bad = blocks.historical_matchups(st, ["season", "m"])
    assert rows(good, "m", "won") == [("m", 1.0)] and rows(bad) == [("a starter without a projection", 1), ("one side only", 1)]
    many = spark.createDataFrame([(s, float(k % 5), 2.0, 2.0, 2.0, float(k % 5 > 1)) for s in (1, 2) for k in range(20)], "season int, mean double, sd double, mean_b double, sd_b double, won double")
    out = blocks.calibration_study(many, "season", [0.5, 1.0, 2.0]).collect()
    assert len(out) == 2 and {r["factor"] for r in out} == {0.5}


def test_actions_and_transitions(spark):
    sw = spark.createDataFrame([(1, "x", "a", "RB", 3.0), (1, "y", "a", "RB", 1.0)], "r int, `into` string, `out` string, slot string, gain double")
    ad = spark.createDataFrame([(1, "z", "d", 2.0, "QB", "q", "starts")], "r int, add string, `drop` string, gain double, slot string, sits string, verdict string")
    k = spark.createDataFrame([("x", datetime(2026, 9, 13)), ("y", datetime(2026, 9, 12)), ("z", datetime(2026, 9, 14))], "entity string, kickoff timestamp")
    got = {r["into"]: (r["place"], r["fallback"]) for r in blocks.action_table(sw, ad, k, "r").collect()}
    assert got == {"y": (1, None), "x": (2, "y"), "z": (3, None)}
    a = spark.createDataFrame([(1, "pre", 0)], "k int, status string, score int")
    b = spark.createDataFrame([(1, "live", 0)], "k int, status string, score int")
    assert rows(blocks.transitions(a, b, ["k"], ["status", "score"])) == [(1, "status", "pre", "live")]
    bench = spark.createDataFrame([(1, "RB", "a", 5.0, "RB"), (1, "RB", "b", 9.0, None)], "r int, c string, e string, points double, slot string")
    assert rows(blocks.outscored_on_bench(bench, "r", "c"), "e", "by") == [("b", 4.0)]


def test_market_tables(spark):
    q = spark.createDataFrame([("g", "b1", "m", "p", "Over", 4.5, -110.0), ("g", "b1", "m", "p", "Under", 4.5, -110.0), ("g", "b2", "m", "p", "Over", 5.5, 100.0)], "event_id string, book string, market string, player string, side string, point double, price double")
    view, aside = blocks.market_view(q)
    assert rows(view, "line", "books") == [(4.5, 1)] and rows(aside) == [("not one clean pair", 1)]
    assert rows(blocks.payload_summary(q)) == [("g", 2, 1, 1, 3)]
    games = spark.createDataFrame([(1, 1, "g"), (1, 2, "h")], "season int, week int, game_id string")
    held = spark.createDataFrame([("g", 60)], "game_id string, lead_minutes int")
    assert rows(blocks.slots_to_cover(games, held, [60, 10])) == [(1, 2, 2, 3)]
