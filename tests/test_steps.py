"""Steps that were repeated for each round, pair or key are made once."""

from panelyard.operators import context
from panelyard.plans import fitting_queries, model_queries
from panelyard.plans.registry import Tables
from panelyard.streaming import feeds, timers

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_judge_kinds_of_player(spark):
    """A player of two positions fits by either, and nothing is counted by name and player."""
    names = spark.createDataFrame([("x", "A", "rush", ["RB"]), ("x", "A", "rec", ["WR"]), (None, "A", "rec", ["WR"])], "name string, team string, market string, allowed_positions array<string>")
    roster = spark.createDataFrame([("A", "1", "RB"), ("A", "1", "WR"), ("A", "2", "WR"), ("A", "3", None)], "team string, player_id string, position string")
    got = context.candidates(names, roster)
    assert [tuple(r) for r in got.collect()] == [("x", "A", "1")]
    assert not [line for line in plan(got).splitlines() if "Aggregate" in line and "name#" in line and "player_id#" in line]


def test_median_line_reads_settled_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(model_queries.M, "median_line", lambda df, x, y: seen.append(plan(df)) or (0.0, 1.0))
    assert model_queries.m7(Tables(spark, SF)).count() > 0
    assert "Join" not in seen[0] and "Window" not in seen[0]


def test_spread_reads_settled_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(fitting_queries.likelihood, "spread_likelihood", lambda df, *_: seen.append(plan(df)) or spark.createDataFrame([("a", 1, 1.0, 1.0, 1.0, 1.0)], "cat string, n int, a double, b double, g double, nll double"))
    fitting_queries.p5_fit(Tables(spark, SF)).count()
    assert "Join" not in seen[0] and "Window" not in seen[0]


def test_props_of_a_kickoff_share_state(spark, tmp_path):
    schema = "game string, prop string, ts timestamp, price double"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    kick = spark.createDataFrame([], "game string, kickoff timestamp")
    stream = feeds.events(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    text = timers.close_at_kickoff(stream, kick, "game", ["prop"], "ts", "price")._jdf.queryExecution().logical().toString()
    assert "part_" in text
