from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelyard.operators import context, fitting, plays, reports


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


PLAY = "season int, week int, game_id string, play_id int, posteam string, passer_id string, rusher_id string, receiver_id string, receiver_position string, pass_attempt int, rush_attempt int, qb_dropback int, qb_scramble int, sack int, qb_spike int, two_point_attempt int, wp double, qtr int, half_seconds_remaining int, game_seconds_remaining int, air_yards int, yardline_100 int, down int, ydstogo int, pass_oe double, fixed_drive int, fixed_drive_result string, score_differential int, caller string"


def play(k, **more):
    base = dict(season=1, week=1, game_id="g", play_id=k, posteam="A", passer_id=None, rusher_id=None, receiver_id=None, receiver_position=None, pass_attempt=None, rush_attempt=None, qb_dropback=None, qb_scramble=None, sack=None, qb_spike=None, two_point_attempt=None, wp=0.5, qtr=1, half_seconds_remaining=900, game_seconds_remaining=3600 - 30 * k, air_yards=None, yardline_100=50, down=1, ydstogo=10, pass_oe=None, fixed_drive=1, fixed_drive_result="Punt", score_differential=0, caller="c")
    return tuple((base | more)[n.split()[0]] for n in PLAY.split(", "))


@pytest.fixture
def game(spark):
    return spark.createDataFrame(
        [
            play(1, pass_attempt=1, qb_dropback=1, passer_id="q", receiver_id="w", receiver_position="TE", air_yards=25, pass_oe=10.0),
            play(2, pass_attempt=1, qb_dropback=1, sack=1, passer_id="q", pass_oe=5.0),
            play(3, rush_attempt=1, rusher_id="r", yardline_100=15, pass_oe=-20.0),
            play(4, rush_attempt=1, qb_scramble=1, qb_dropback=1, passer_id="q", rusher_id="q", wp=0.95),
            play(5, pass_attempt=1, qb_dropback=1, passer_id="b", receiver_id="w", receiver_position="WR", air_yards=3, fixed_drive=2, fixed_drive_result="Touchdown", yardline_100=4),
        ],
        PLAY,
    )


def test_play_classes(game):
    got = game.select(*[F.count_if(p).alias(n) for n, p in {"target": plays.is_target(), "run": plays.is_designed_run(), "scramble": plays.is_scramble(), "neutral": plays.is_neutral(), "deep": plays.is_deep(), "aimed": plays.is_aimed_pass()}.items()]).first()
    assert got.asDict() == {"target": 2, "run": 1, "scramble": 1, "neutral": 4, "deep": 1, "aimed": 2}
    assert rows(plays.drives(game), "fixed_drive", "closest", "result") == [(1, 15, "Punt"), (2, 4, "Touchdown")]
    obs = plays.tendency_observations(game, "caller", min_runs=1)
    kinds = {r["kind"]: r["n"] for r in obs.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds == {"proe": 3, "pass_rate": 4, "pace": 2, "concentration": 1, "te_target": 2}


def test_routes_histories_and_relief(spark, game):
    part = spark.createDataFrame([("g", 1, "w; q"), ("g", 2, "q;w"), ("g", 3, "r"), ("g", 5, "w")], "game_id string, play_id int, offense_players string")
    assert rows(plays.routes(game, part), "player_id", "routes", "dropbacks") == [("q", 2, 4), ("w", 3, 4)]
    played = spark.createDataFrame([("g", "A", "w"), ("g", "A", "z")], "game_id string, posteam string, receiver_id string")
    h = plays.event_history(game, played, "receiver_id", "posteam", ["game_id"], {"targets": plays.is_target()})
    assert rows(h, "receiver_id", "targets", "targets_team") == [("w", 2, 2), ("z", 0, 2)]
    r = plays.relief(game, least=1)
    assert rows(r, "passer_id", "started", "relieved") == [("b", False, True), ("q", True, False)]


def test_injury_words(spark):
    df = spark.createDataFrame([("Hamstring",), ("Not injury related - rest",), (None,), ("Knee",)], "x string")
    assert [tuple(r) for r in df.select(plays.is_soft_tissue(F.col("x")), plays.is_real_injury(F.col("x"))).collect()] == [(True, True), (False, False), (False, False), (False, True)]


def test_schedule_and_weather(spark):
    games = spark.createDataFrame([(2025, 1, "o", "s", 40.0, 0.0, "B", "A"), (2026, 1, "g", "s", 50.0, 4.0, "A", "B")], "season int, week int, game_id string, stadium_id string, total_line double, spread_line double, home_team string, away_team string")
    venues = spark.createDataFrame([("s", "outdoors", "America/New_York")], "stadium_id string, roof string, tz string")
    got = context.schedule_context(games, venues).where("season = 2026")
    assert rows(got, "team", "is_home", "implied", "spread", "total_over_last") == [("A", 1, 27.0, 4.0, 10.0), ("B", 0, 23.0, -4.0, 10.0)]
    k = datetime(2026, 9, 13, 17, 25)
    hours = spark.createDataFrame([("s", datetime(2026, 9, 13, 17) + timedelta(hours=h), 12.0 + h, 1.0) for h in range(3)], "stadium_id string, time timestamp, wind double, rain double")
    at = spark.createDataFrame([("g", "s", "outdoors", k), ("d", "s", "dome", k), ("n", "t", "outdoors", k)], "game_id string, stadium_id string, roof string, kickoff timestamp")
    assert {r["game_id"]: (r["wind10"], r["rain"], r["weather_source"]) for r in context.weather(at, hours).collect()} == {"g": (3.0, 3.0, "observed"), "d": (0.0, 0.0, "roof"), "n": (None, None, "unknown")}


def test_imports_notes_and_candidates(spark):
    now = F.to_timestamp(F.lit("2026-09-10"))
    x = spark.createDataFrame([("a", datetime(2026, 9, 1)), ("b", datetime(2026, 9, 20)), ("c", datetime(2026, 9, 1)), ("c", datetime(2026, 9, 2)), (None, None)], "id string, at timestamp")
    good, bad = context.dated_import(x, now, "id", "at")
    assert rows(good, "id") == [("a",)] and sorted(r["reason"] for r in bad.collect()) == ["dated in the future", "id repeats", "id repeats", "no id"]
    players = spark.createDataFrame([("p",), ("q",)], "player_id string")
    rep = spark.createDataFrame([("p", datetime(2026, 9, 1), "Out", None, None), ("q", datetime(2026, 9, 9), "Out", None, None)], "player_id string, at timestamp, report_status string, practice_status string, injury string")
    tag = spark.createDataFrame([("p", datetime(2026, 9, 9), "IR"), ("q", datetime(2026, 9, 9), "Sus")], "player_id string, at timestamp, tag string")
    assert rows(context.availability_note(players, rep, tag, now), "player_id", "designation") == [("p", "IR"), ("q", "Out")]
    names = spark.createDataFrame([("x", "A", "rush", ["RB", "QB"]), ("x", "A", "rec", ["RB", "WR"])], "name string, team string, market string, allowed_positions array<string>")
    roster = spark.createDataFrame([("A", "1", "RB"), ("A", "2", "WR"), ("A", "3", "QB"), ("B", "4", "RB")], "team string, player_id string, position string")
    assert rows(context.candidates(names, roster), "player_id") == [("1",)]
    t = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1)], "team string, week int")
    proofs = spark.createDataFrame([("A", [2])], "team string, off_periods array<int>")
    g = spark.createDataFrame([("A", 1)], "team string, week int")
    assert rows(context.game_of_team(t, g, proofs, F.lit(True)), "team", "week", "state") == [("A", 1, "game"), ("A", 2, "bye"), ("B", 1, "no row")]


def test_defense_points_are_null_when_unknown(spark):
    tw = spark.createDataFrame([(1, 1, "A", 3.0, 1.0), (1, 1, "B", 0.0, 0.0)], "season int, week int, team string, sacks double, interceptions double")
    games = spark.createDataFrame([(1, 1, "A", "C", 20.0, 10.0)], "season int, week int, home_team string, away_team string, home_score double, away_score double")
    assert {r["team"]: r["points"] for r in context.defense_history(tw, games).collect()} == {"A": 3 + 2 + 4.0, "B": None}


def test_override_and_contender(spark):
    df = spark.createDataFrame([(1, 10.0, 3.0, True), (2, 8.0, 2.0, False)], "k int, m double, s double, out boolean")
    assert rows(fitting.override(df, "m", "s", F.col("out")), "k", "m", "model_mean") == [(1, 0.0, 10.0), (2, 8.0, 8.0)]
    rates = spark.createDataFrame([(1, 50.0, 0.3), (2, 20.0, 0.1)], "entity int, yards double, tds double")
    exp = spark.createDataFrame([(1, "yards", 70.0)], "entity int, stat string, expected double")
    got = {r["entity"]: (r["points"], r["from_rates"], r["reason"]) for r in fitting.market_contender(rates, exp, {"yards": 0.1, "tds": 6.0}).collect()}
    assert got[1][0] == pytest.approx(7 + 1.8) and got[1][1] == ["tds"] and got[2][0] is None and got[2][2] == "no market"
    assert fitting.composed({"(1)": 2.0, "x": 3.0}, 1.0, 0.5) == {"(1)": 2.0, "x": 1.5}


def test_decision_tables(spark):
    lu = spark.createDataFrame([(1, "a", "RB", ["RB", "FLEX"]), (1, "b", "FLEX", ["RB", "FLEX"]), (1, "q", "QB", ["QB"])], "r int, e string, slot string, can array<string>")
    cur = spark.createDataFrame([(1, "a", "FLEX"), (1, "b", "RB"), (1, "q", "QB")], "r int, e string, slot string")
    assert rows(reports.retained(lu, cur, ["r"], "e"), "e", "slot") == [("a", "FLEX"), ("b", "RB"), ("q", "QB")]
    traps = reports.reserve_traps(spark.createDataFrame([("a", True), ("b", True), ("c", False)], "entity string, on_reserve boolean"), spark.createDataFrame([("a", "IR")], "entity string, tag string"), ["IR"])
    assert rows(traps, "entity") == [("b",)]
    st = spark.createDataFrame([("i", "OPEN", None), ("o", "OPEN", None), ("x", "OPEN", "out"), ("l", "LOCKED", None)], "entity string, lock string, availability string")
    acts = spark.createDataFrame([("i", "o"), ("x", "o"), ("i", "l"), ("i", "?")], "`into` string, `out` string")
    assert sorted(r["now"] for r in reports.judged_again(acts, st).collect()) == ["stands", "too late", "unknown", "withdrawn: not playing"]
    tot = reports.side_totals(spark.createDataFrame([(1, 0, 5.0, None, None, "final"), (1, 1, 3.0, 4.0, None, "final")], "m int, s int, points double, override double, projection double, state string"), ["m", "s"])
    assert rows(reports.settled(tot, "m", "s")) == [(1, 1.0, True)]
    sw = spark.createDataFrame([("i", "o")], "`into` string, `out` string")
    assert reports.against_trend(sw, spark.createDataFrame([("i", "FALLING"), ("o", "RISING")], "entity string, trend string")).count() == 1


def test_cards_and_roll_ups(spark):
    g = spark.createDataFrame([(1, 1, 1, 10, 5, 0.5, 4.0), (1, 1, 2, 10, 5, 0.6, 3.0), (1, 2, 1, 30, 5, 0.8, 5.0)], "season int, week int, graded_at int, pairs int, rows int, page_pairwise double, page_mae double")
    c = reports.card(g, ["page"]).first()
    assert (c["weeks"], c["pairs"]) == (2, 40) and c["page_pairwise"] == pytest.approx((6 + 24) / 40) and c["page_mae"] == 4.0
    r = spark.createDataFrame([("x", [(0.6, 0.5, 3.0, 4.0), (0.7, 0.5, 3.0, 2.0)])], "name string, folds array<struct<pairwise: double, base_pairwise: double, mae: double, base_mae: double>>")
    out = reports.roll_up(r).first()
    assert (out["folds"], out["better"], out["accepted"]) == (2, 1, False)
    bad = reports.reproduced(spark.createDataFrame([(1, 1.0)], "k int, v double"), spark.createDataFrame([(1, 1.5)], "k int, v double"), ["k"], "v", 0.1).first()
    assert not bad["same"] and bad["largest_gap"] == 0.5


def test_next_in_line_reads_the_first_places_and_not_whole_charts(spark):
    n = 6000  # every one of one team's category is away: pairs would be 36 million rows
    who = spark.range(n).select(F.col("id").alias("entity"), F.lit(1).alias("team"), F.lit("a").alias("category"), (F.col("id") % 4).alias("depth"))
    out = reports.behind(who, who, who.select("entity", (F.col("entity") % 100).alias("work")))
    got = out.groupBy("away").agg(F.sort_array(F.collect_list(F.struct("rank", "entity"))).alias("x")).collect()
    assert len(got) == n
    for r in got:
        # Depth 0 are multiples of 4; the most work among them is 96, at 96, 196, 296.
        assert [x["entity"] for x in r["x"]] == [e for e in (96, 196, 296) if e != r["away"]][:2]
    joined = [line for line in out._jdf.queryExecution().toString().split("\n") if "WindowGroupLimit" in line]
    assert joined  # a group's rows are cut before they meet the vacancies


def test_next_in_line_with_rows_repeated_in_a_chart(spark):
    charts = spark.createDataFrame([("x", 1, "a", 0), ("x", 1, "a", 0), ("x", 1, "a", 0), ("y", 1, "a", 1), ("z", 1, "a", 2), (None, 1, "a", 0)], "entity string, team int, category string, depth int")
    away = spark.createDataFrame([("x", 1, "a"), ("y", 1, "a"), ("q", 1, "a"), ("y", 2, "a")], "entity string, team int, category string")
    work = spark.createDataFrame([("y", 5)], "entity string, work long")
    assert rows(reports.behind(away, charts, work), "away", "entity", "rank") == [("q", "x", 1), ("q", "x", 2), ("x", "y", 1), ("x", "z", 2), ("y", "x", 1), ("y", "x", 2)]
