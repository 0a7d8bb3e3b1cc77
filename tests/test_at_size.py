"""Steps whose cost grew faster than their rows, and what they left out."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.operators import exchange, scored

KIND = "roster int, cat string, entity int, pts int, now string, movable boolean"
ARGS = ("cat", "pts", "entity", {"A": 2, "B": 1}, ["B"], 1, "now", "movable")


def test_a_roster_of_one_starter_can_drop_him(spark):
    frame = spark.createDataFrame([(1, "A", 5, 10, "A", True)], KIND)
    ways = exchange.exchanges(frame, ["roster"], *ARGS, droppable=F.col("movable"))
    free = spark.createDataFrame([("A", 9, 7)], "cat string, entity int, pts int")
    board = exchange.add_drop_gains(free, ways, ["roster"], [], "cat", "pts", "entity").collect()
    assert [(b["drop"], b["gain"]) for b in board] == [(5, -3)]


def test_the_cheapest_of_the_bench_stands_for_it(spark):
    rows = [(1, "A", k, 20 - k, None, True) for k in range(1, 9)] + [(1, "B", 20 + k, 3 + k, None, True) for k in range(4)]
    frame = spark.createDataFrame(rows, KIND)
    free = spark.createDataFrame([("A", 99, 30), ("B", 98, 1)], "cat string, entity int, pts int")
    boards = []
    for cheapest in (False, True):
        ways = exchange.exchanges(frame, ["roster"], *ARGS, droppable=F.col("movable"), cheapest_bench=cheapest)
        boards.append(sorted(map(tuple, exchange.add_drop_gains(free, ways, ["roster"], [], "cat", "pts", "entity").select("add", "drop", "gain", "sits").collect())))
    assert boards[0] == boards[1] == [(98, 20, 0, None), (99, 20, 12, 2)]


def test_a_draft_is_read_with_a_frame_that_grows(spark):
    picks = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 7), (1, None, 8), (1, None, 1)], "draft int, pick int, value int")
    got = scored.draft_ledger(picks)
    assert sorted((r["pick"], r["best_left"], r["given_up"]) for r in got.collect()) == [(1, 9, 4), (2, 8, 0), (3, 8, 1)]
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
