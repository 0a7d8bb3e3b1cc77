import random

import xxhash
from pyspark.sql import functions as F

from panelyard.llm import simhash
from panelyard.llm.common import connected_components


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    x = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return x - (1 << 64) if x >> 63 else x


def brute_components(values, linked):
    label = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if linked(a, b) and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_masks_cover_every_pair_within_two_bits():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(i + 1):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_fingerprints_match_brute_force_and_edge_cases(spark, docs, nothing):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["fingerprint"] == brute_print(texts[r["doc_id"]]) for r in got)
    comp = {r["doc_id"]: r["component_id"] for r in got}
    assert comp[1] == comp[2] == 1 and comp[3] == comp[4] == comp[5] == 3 and comp[7] == 7 and comp[None] is None
    assert simhash.near_duplicates(nothing).count() == 0


def test_links_match_brute_force_in_small_and_large_buckets(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = set(base)
    for b in base:
        for _ in range(40):
            x = b
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    want = brute_components(signed, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 2)
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    for bucket in (256, 2):
        comps = connected_components(simhash.fingerprint_links(df, bucket=bucket))
        got = {r["node"]: r["component"] for r in comps.collect()}
        assert {v: got.get(v, v) for v in signed} == want


def test_keep_one_keeps_the_smallest_id_of_each_group(spark, docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 6, 7, 8]


def test_keep_one_keeps_different_texts_with_null_or_repeated_ids(spark):
    rows = [(None, "one text without any id"), (None, "a second one that has no id either"), (None, "copied from a row with an id"), (4, "copied from a row with an id"), (5, "the first of two with one id"), (5, "something else under that same number"), (6, "the first of two with one id")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept) == sorted((i or -1, t) for i, t in [rows[0], rows[1], rows[3], rows[4], rows[5]])


def test_keep_one_drops_every_copy_of_five_word_similarity(spark):
    rng, texts = random.Random(3), []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(150)]
        for edits in (0, 0, 1, 2, 3, 4, 6):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    want = brute_components(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in kept} == set(want.values())


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r["component"] for r in connected_components(edges).collect()} == {1}


def test_one_row_of_each_group_whatever_the_columns(spark, docs):
    odd = docs.withColumns({"a.b": F.lit(1), "m": F.create_map(F.lit("k"), "h"), "__k": F.lit("mine"), "n": F.lit(2), "id": F.lit(3), "doc": F.lit(4), "whole": F.lit(5)})
    got = simhash.keep_one(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in simhash.keep_one(docs).collect()) and all(r["__k"] == "mine" for r in rows)


def test_large_groups_of_near_copies_equal_brute_force(spark, monkeypatch):
    """One base text with more or fewer words changed: buckets above FEW, cut into several blocks."""
    monkeypatch.setattr(simhash, "FEW", 6)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(9)
    base = rng.choices([f"w{k}" for k in range(300)], k=150)
    texts = []
    for k in range(160):
        words = list(base)
        for at in rng.sample(range(150), k % 9):
            words[at] = f"x{rng.randrange(40)}"
        texts.append(" ".join(words))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    group = list(range(160))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(160):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group[max(top(i), top(j))] = min(top(i), top(j))
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert kept == {i for i in range(160) if top(i) == i} and 1 < len(kept) < 120


def test_copies_within_the_bits_of_a_simhash_need_no_band(spark, monkeypatch):
    """Bands that no two texts share: what SimHash holds together is checked and joined all the same."""
    bare = simhash.sketches
    monkeypatch.setattr(simhash, "sketches", lambda *a, **k: bare(*a, **k).withColumn("keys", F.array(F.col("node"))))
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(4000)]
    other = [f"v{rng.randrange(900)}" for _ in range(4000)]
    texts = [" ".join(base), "  ".join(base), " ".join([*base[:-1], "x"]), " ".join(other), "\n".join(other).upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = {r["doc_id"]: r["fingerprint"] for r in simhash.fingerprints(docs, shingle=5).collect()}
    assert bin((prints[0] ^ prints[2]) & (2**64 - 1)).count("1") <= 2
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [0, 3]
