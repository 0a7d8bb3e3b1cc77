import numpy as np

from panelyard.llm import embeddings


def brute(rows, threshold=0.95):
    ok = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i, _ in rows}
    for a in ok:
        for b in ok:
            if a != b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= threshold:
                links[a].add(b)
    label = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for i, js in links.items():
            low = min([label[i], *(label[j] for j in js)])
            if low < label[i]:
                label[i], changed = low, True
    return {i: (len(links[i]), label[i]) for i in links}


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, rep string, n int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df, **options).collect()}
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_random_and_near_vectors_over_several_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=24).tolist()) for k in range(150)]
    for k in range(150, 330):
        base = np.array(rows[k % 17][1])
        rows.append((k, (base + rng.normal(size=24) * rng.choice([0.0, 0.1, 0.25, 0.33])).tolist()))
    check(spark, rows)
    check(spark, rows, block=40)


def test_vectors_without_a_direction_link_with_nothing(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [1.0, float("nan")]), (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (10, [-0.0, 1.0]), (11, [0.0, 1.0]), (12, [1.0])]
    check(spark, rows)


def test_empty_and_unusable_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(empty).count() == 0
    check(spark, [(1, None), (2, [0.0])])


def test_null_and_repeated_ids_link_by_their_vectors(spark):
    near = [[1.0, 0.0], [0.97, 0.2431], [0.8829, 0.4695], [-1.0, 0.0]]
    rows = [(1, near[0], "x"), (None, near[1], "x"), (3, near[2], "x"), (7, near[3], "x"), (7, near[1], "x"), (None, [0.0, 0.0], "x")]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string")).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == sorted([("1", 2, "1"), ("None", 3, "1"), ("3", 2, "1"), ("7", 0, "7"), ("7", 3, "1"), ("None", 0, "None")])
