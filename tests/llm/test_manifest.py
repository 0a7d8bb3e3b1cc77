import hashlib
import zlib

from pyspark.sql import functions as F

from panelyard.llm import manifest

KIND = "doc_id long, source string, lang string, n_chars long, text string"
low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(r):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) by plain lists."""
    langs = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        langs.setdefault(r[2], []).append(r)
    names = sorted(langs, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: levels([leaf(r) for r in langs[k]]) for k in names}
    top = levels([trees[k][-1][0] for k in names])
    out = []
    for n, k in enumerate(names):
        for i, r in enumerate(langs[k]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            now, siblings = leaf((*r[:4], r[4].translate(low)) if hit else r), []
            for tree, at in ((trees[k], i), (top, n)):
                for level in tree[:-1]:
                    lo = at - at % 8
                    left, right = level[lo:at], level[at + 1 : lo + 8]
                    siblings += left + right
                    now, at = h(*left, now, *right), at // 8
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], h(*siblings), now, now == top[-1][0]))
    return sorted(out, key=str)


def made(spark, rows):
    return sorted(map(tuple, manifest.manifest(spark.createDataFrame(rows, KIND)).collect()), key=str)


def texts(n, lang=lambda k: "en"):
    return [(k, f"s{k % 3}", lang(k), k * 7, f"Text Número {k} ÀB") for k in range(n)]


def test_equals_plain_lists(spark):
    for n in (1, 8, 65, 600):
        rows = texts(n)
        assert made(spark, rows) == brute(rows), n
    rows = texts(300, lambda k: None if k % 3 == 0 else f"l{k % 11}" if k % 2 else "é")
    assert made(spark, rows) == brute(rows)


def test_several_blocks_and_very_many_langs(spark, monkeypatch):
    monkeypatch.setattr(manifest, "SPAN", 8)
    monkeypatch.setattr(manifest, "LEVELS", 1)
    monkeypatch.setattr(manifest, "height", lambda total, most=1: (total > 1).cast("int"))
    rows = texts(700, lambda k: "hot" if k % 3 else f"l{k}")
    assert made(spark, rows) == brute(rows)


def test_edges(spark, docs, nothing):
    rows = [*texts(20), (None, None, None, None, None), (None, "a", "en", 1, "X"), (3, "s0", "en", 21, "Text Número 3 ÀB"), (4, None, None, None, ""), (9, "x", "", 1, None)]
    assert made(spark, rows) == brute(rows)
    assert manifest.manifest(docs).count() == docs.count() and manifest.manifest(nothing).count() == 0 and manifest.copied_nodes(nothing).count() == 0


def test_versions_share_all_but_their_paths(spark):
    rows = texts(200, lambda k: f"l{k % 10}")
    frame = spark.createDataFrame(rows, KIND)
    copied = manifest.copied_nodes(frame).orderBy("doc_id", "level").collect()
    by_doc = {}
    for r in copied:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == {k for k in range(200) if zlib.crc32(str(k).encode()) % 3 == 0}
    folded = {r["doc_id"]: r["folded_root"] for r in manifest.manifest(frame).collect()}
    for doc, path in by_doc.items():
        assert len(path) == 2 + 2 + 1 and path[-1]["node"] == folded[doc]  # 20 leaves, then 10 subroots
        changed = [(*r[:4], r[4].translate(low)) if r[0] == doc else r for r in rows]
        tree = levels([leaf(r) for r in sorted(changed) if r[2] == f"l{doc % 10}"])
        assert all(tree[r["level"]][r["pos"]] == r["node"] for r in path if not r["top"])
        assert [r["pos"] for r in path if r["top"]] == [doc % 10 // 8, 0]


def test_only_texts_that_change_are_not_verified(spark):
    frame = spark.createDataFrame([(k, "s", "en", 1, "lower already" if k % 2 else "Upper") for k in range(60)], KIND)
    got = manifest.manifest(frame, F.col("doc_id") % 5 == 0).collect()
    assert {r["doc_id"] for r in got if not r["verified"]} == {k for k in range(60) if k % 10 == 0}
