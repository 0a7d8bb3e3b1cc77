import random

import numpy as np

from panelyard.llm import negatives

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows):
    ok = [(i, lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, la, va in {(i, lab, tuple(v)) for i, lab, v in ok if i % 50 == 0}:
        scored = [(-sum(p * q for p, q in zip(va, v, strict=True)), i, lab) for i, lab, v in ok if len(v) == len(va)]
        same = sorted(x for x in scored if x[2] == la and x[1] != a)[:5]
        for s, p, _ in same:
            window = sorted(x for x in scored if x[2] != la and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(a, p, k + 1, x[1], -s, -x[0]) for k, x in enumerate(window)]
    return sorted(out)


def made(seed, n, dims=6, labels=4, step=0.25):
    rng = random.Random(seed)
    return [(k, [rng.randint(-4, 4) * step for _ in range(dims)], rng.randrange(labels)) for k in range(n)]


def mined(spark, rows, **args):
    return sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, KIND), **args).collect()))


def test_equals_brute_force_with_many_ties(spark):
    for seed, n in ((1, 400), (2, 90)):
        rows = made(seed, n)
        want = brute(rows)
        assert want and mined(spark, rows, block=64, anchor_block=3) == want
        assert mined(spark, rows[::-1]) == want


def test_hot_label_and_copies(spark):
    rows = [(k, [1.0, 0.5, 0.25], 0) if k % 3 else (k, [0.9 - k / 4000, 0.5, 0.1], 1 + k % 2) for k in range(600)]
    want = brute(rows)
    assert len(want) > 50 and mined(spark, rows, block=50, anchor_block=4) == want


def test_edges(spark):
    rows = made(3, 120)
    odd = [(None, [1.0] * 6, 1), (200, None, 1), (250, [1.0] * 6, None), (300, [float("nan")] * 6, 1), (350, [None] + [1.0] * 5, 1), (400, [float("inf")] + [1.0] * 5, 1), (450, [], 1), (500, [1.0, 2.0], 1), (501, [1.0, 1.5], 1), (502, [1.0, 0.9], 2), (503, [0.0] * 6, 2)]
    assert mined(spark, rows + odd) == brute(rows + odd)
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(50, [1.0], 1)]) == []
    assert mined(spark, [*rows, rows[0], rows[50]]) == brute([*rows, rows[0], rows[50]])
    wide = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], KIND + ", anchor string, slot int, score double")
    assert sorted(map(tuple, negatives.mine(wide).collect())) == brute(rows)


def test_labels_change_first(spark):
    got = {r["vec_id"]: r["label"] for r in negatives.relabelled(spark.createDataFrame([(7, [1.0], 9), (8, [1.0], 9), (14, [1.0], None), (0, [1.0], 0)], KIND)).collect()}
    assert got == {7: 0, 8: 9, 14: None, 0: 1}


def test_largest_with_scores_too_great_for_one_long():
    rng = np.random.default_rng(4)
    score, allowed = rng.integers(-5, 5, (30, 40)), rng.random((30, 40)) < 0.3
    for most in (5, 1 << 61):
        top, at = negatives.largest(score, allowed, 3, most)
        for i in range(30):
            want = sorted(((-score[i, j], j) for j in range(40) if allowed[i, j]))[:3]
            assert sorted((-s, j) for s, j in zip(top[i], at[i], strict=True) if s != negatives.NONE) == want
