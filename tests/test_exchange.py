import random

import pytest
from pyspark.sql import functions as F

from panelyard.operators import exchange

SLOTS, FLEX, FLEX_SLOTS = {"A": 2, "B": 1, "C": 1}, ["B", "C", "D"], 2
KIND = "roster int, cat string, entity int, pts int, now string, movable boolean"
ARGS = ("cat", "pts", "entity", SLOTS, FLEX, FLEX_SLOTS, "now", "movable")


def filled(rows):
    """The rule row by row: fixed starters stay, then dedicated slots, then flexible ones."""
    slot = {}
    left = dict(SLOTS, FLEX=FLEX_SLOTS)
    pool = []
    for _, cat, e, pts, now, movable in rows:
        if movable and pts is not None:
            pool.append((-pts, e, cat))
        elif now in left:
            slot[e] = now
            left[now] -= 1
    for kind in (*SLOTS, "FLEX"):
        for _, e, cat in sorted(pool):
            if e not in slot and left[kind] > 0 and (cat == kind or kind == "FLEX" and cat in FLEX):
                slot[e] = kind
                left[kind] -= 1
    return slot


def points(rows):
    slot = filled(rows)
    return sum(r[3] or 0 for r in rows if r[2] in slot)


def best_by_trial(rows):
    """The most points of any legal assignment of the movable rows, by trying all."""
    left = dict(SLOTS, FLEX=FLEX_SLOTS)
    fixed = 0
    free = []
    for _, cat, _e, pts, now, movable in rows:
        if movable and pts is not None:
            free.append((cat, pts))
        elif now in left:
            left[now] -= 1
            fixed += pts or 0

    def go(k, left):
        if k == len(free):
            return 0
        cat, pts = free[k]
        best = go(k + 1, left)
        for kind in {cat, "FLEX"} if cat in FLEX else {cat}:
            if left.get(kind, 0) > 0:
                best = max(best, pts + go(k + 1, {**left, kind: left[kind] - 1}))
        return best

    return fixed + go(0, left)


def made(seed, rosters=6, size=9, least=1):
    rng = random.Random(seed)
    out, e = [], 0
    for r in range(rosters):
        own = []
        for _ in range(rng.randint(2, size)):
            e += 1
            own.append([r, rng.choice("AABBCCDE"), e, rng.choice([None, *range(least, 12)]), None, rng.random() < 0.8])
        left = dict(SLOTS, FLEX=FLEX_SLOTS)
        for row in rng.sample(own, len(own)):  # any legal current lineup
            for kind in (row[1], "FLEX"):
                if left.get(kind, 0) > 0 and (kind == row[1] or row[1] in FLEX) and rng.random() < 0.7:
                    row[4] = kind
                    left[kind] -= 1
                    break
        out += map(tuple, own)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_locked_lineup_is_the_best_that_can_be_reached(spark, seed):
    rows = made(seed, 12)
    got = exchange.locked_lineup(spark.createDataFrame(rows, KIND), ["roster"], *ARGS).collect()
    for r in {r[0] for r in rows}:
        own = [x for x in rows if x[0] == r]
        assert {x["entity"]: x["slot"] for x in got if x["roster"] == r and x["slot"]} == filled(own)
        assert points(own) == best_by_trial(own)


@pytest.mark.parametrize("seed", [4, 5])
def test_gain_of_every_add_and_drop_is_that_of_a_rerun(spark, seed):
    rows = made(seed, 8)
    pool = [(cat, 1000 + 10 * k + n, v) for k, cat in enumerate("ABCDE") for n, v in enumerate((1, 4, 7, 15))]
    frame, free = spark.createDataFrame(rows, KIND), spark.createDataFrame(pool, "cat string, entity int, pts int")
    ways = exchange.exchanges(frame, ["roster"], *ARGS, droppable=F.col("movable") & F.col("pts").isNotNull())
    got = {(r["roster"], r["add"], r["drop"]): r["gain"] for r in exchange.exchange_gains(free, ways, [], "cat", "pts", "entity").collect()}
    want, best = {}, {}
    for r in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == r]
        drops = [x for x in own if x[5] and x[3] is not None]
        for cat, e, v in pool:
            if cat == "E":
                continue  # of no slot
            for d in (None, *drops):
                trial = [x for x in own if x != d] + [(r, cat, e, v, None, True)]
                want[r, e, d and d[2]] = points(trial) - points(own)
            if drops:
                best[r, e] = max((want[r, e, d[2]], -d[3], -d[2]) for d in drops)
    assert got == want
    board = exchange.add_drop_gains(free, ways, ["roster"], [], "cat", "pts", "entity").collect()
    named = {(b["roster"], b["add"]): (b["gain"], b["drop"]) for b in board if b["drop"] is not None}
    assert named == {k: (g, -d) for k, (g, _, d) in best.items()}


def test_an_empty_slot_takes_the_addition_whole(spark):
    rows = [(1, "A", 1, 10, "A", True), (1, "A", 2, 9, "A", True), (1, "B", 3, 5, "B", True), (1, "A", 4, 1, None, True)]
    free = spark.createDataFrame([("B", 9, 7), ("A", 8, 11)], "cat string, entity int, pts int")
    frame = spark.createDataFrame(rows, KIND)
    droppable = F.col("movable")
    ways = exchange.exchanges(frame, ["roster"], *ARGS, droppable=droppable)
    board = exchange.verdicts(exchange.add_drop_gains(free, ways, ["roster"], [], "cat", "pts", "entity"), exchange.cheapest_of_category(frame, ["roster"], "cat", "pts", "entity", droppable), ["roster"], "cat")
    got = {r["add"]: (r["drop"], r["gain"], r["sits"], r["verdict"]) for r in board.collect()}
    assert got == {9: (4, 7, None, "LINEUP"), 8: (4, 2, 2, "LINEUP")}


def test_open_places_protected_rosters_and_verdicts(spark):
    rows = [(1, "A", 1, 10, "A", True), (1, "A", 2, 9, "A", True), (2, "A", 3, 10, "A", False), (2, "A", 4, 8, "A", False), (3, "A", 5, 10, "A", True), (3, "A", 6, 9, "A", True), (3, "A", 7, 3, None, True), (4, "B", 8, None, None, None)]
    free = spark.createDataFrame([("A", 90, 12), ("A", 91, 5), ("A", 92, 2), ("A", 93, None)], "cat string, entity int, pts int")
    frame = spark.createDataFrame(rows, KIND)
    droppable = F.col("movable")
    ways = exchange.exchanges(frame, ["roster"], *ARGS, droppable=droppable)
    spare = spark.createDataFrame([(1,)], "roster int")
    versus = exchange.cheapest_of_category(frame, ["roster"], "cat", "pts", "entity", droppable)
    got = {(r["roster"], r["add"]): (r["drop"], r["gain"], r["verdict"], r["gap"]) for r in exchange.verdicts(exchange.add_drop_gains(free, ways, ["roster"], [], "cat", "pts", "entity", spare), versus, ["roster"], "cat").collect()}
    assert got[1, 90] == (None, 3, "LINEUP", 3) and got[2, 90] == (None, None, "COVERAGE", None) and got[3, 90] == (7, 3, "LINEUP", 9)
    assert got[3, 91] == (7, 0, "RESEARCH", 2) and got[3, 92] == (7, 0, "BELOW", -1) and (1, 93) not in got and got[4, 90][2] == "COVERAGE"
