import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from panelyard.llm import merkle, mixing, packing, warc


def test_mix_meets_targets(spark, docs, nothing):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * int(rng.paretovariate(1.2) * 20)), f"s{k % 5}" if k % 3 else "s0") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    size, weight = Counter(), dict(zip(["s0", "s1", "s2", "s3", "s4"], [3, 1, 2, 3, 1], strict=True))
    for r in got:
        size[r["source"]] += r["size"]
    open_, target = set(size), {}
    while True:
        rest = 1.5 * sum(size.values()) - sum(2 * size[s] for s in size if s not in open_)
        target = {s: rest * weight[s] / sum(weight[t] for t in open_) if s in open_ else 2.0 * size[s] for s in size}
        if not (over := {s for s in open_ if target[s] > 2 * size[s] * (1 + 1e-12)}):
            break
        open_ -= over
    taken = Counter()
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and 0 <= r["copies"] <= 2 and r["source_size"] == size[r["source"]]
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - target[s]) < 0.05 * target[s] for s in size)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))
    edge = mixing.mix(docs).collect()
    assert len(edge) == docs.count() and {r["source"] for r in edge} == {"a", "b", "c", None}
    assert mixing.mix(nothing).count() == 0
    out = mixing.take(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in edge)
    odd = docs.withColumns({"a.b": F.lit(1), "m": F.create_map(F.lit("k"), "h"), "__row": F.lit("r")})
    assert mixing.take(odd).columns == odd.columns and mixing.take(odd).count() == out.count()


def test_the_mix_takes_the_same_texts_in_any_order(spark):
    rows = [(None if k % 5 else k, f"one two three {k}", "s", k) for k in range(400)] + [(None, "four words stand here", "t", 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    want = sorted(map(str, mixing.take(df).collect()))
    for parts in (1, 7):
        assert sorted(map(str, mixing.take(df.orderBy(F.desc("text")).repartition(parts)).collect())) == want
    assert want != sorted(map(str, df.collect()))


def whole(pieces, docs_tokens, length=2048):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert sorted(by_seq) == list(range(len(by_seq)))
    padding = 0
    for spans in by_seq.values():
        at = 0
        for off, n in sorted(spans):
            assert off == at and n > 0
            at += n
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    assert sum(p["length"] for p in pieces) == docs_tokens
    return by_doc, padding


def test_pack_every_token_once(spark, docs, nothing):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(k, f"Some tokens of document {k}! " * (k % 90) + "ünïcode ² ٣ 　 tail", f"s{k % 4}" if k % 4 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    ids = {k: np.array(tok.encode(t, add_special_tokens=False).ids + [1], dtype="<u4") for k, t, _ in rows}
    pieces = packing.pack(df, window=2).collect()
    by_doc, padding = whole(pieces, sum(map(len, ids.values())))
    assert padding == 0
    for k, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[k])
            assert p["ids_crc32"] == zlib.crc32(ids[k][at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids[k])
    total, share, windows = sum(map(len, ids.values())), Counter(), {}
    for k, _, s in rows:
        share[s] += len(ids[k]) / total
    for p in pieces:
        windows.setdefault(p["sequence_id"] // 2, Counter())[p["source"]] += p["length"]
    for w in range(total // 4096):
        assert all(abs(windows[w][s] - 4096 * share[s]) <= 3 for s in share)
    edge = packing.pack(docs).collect()
    by_doc, _ = whole([p for p in edge], sum(p["length"] for p in edge))
    assert {3, 4, 5, None} <= set(by_doc) and by_doc[3][0]["length"] == 1 and sum(p["length"] for p in by_doc[2]) == 2 * by_doc[2][0]["doc_tokens"]
    assert packing.pack(nothing).count() == 0


def test_round_robin_by_given_weights_equals_a_simulation():
    plan = packing.RoundRobin([500, 90, 1000], [3.0, 1.0, 2.0], 64)
    turns = sorted(((j + 0.5) / w, q) for q, (n, w) in enumerate(zip([500, 90, 1000], [3.0, 1.0, 2.0], strict=True)) for j in range(n))
    got = plan.served(np.arange(0, 26))
    for w in range(26):
        want = Counter(q for _, q in turns[: 64 * w])
        assert got[w].tolist() == [want[0], want[1], want[2]]


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 300
    rows = [(1, "http://b.example.com/x y", big), (2, "http://a.example.com", big), (3, None, None), (4, "http://a.example.com", "ü" * 40), (5, "http://a.example.com", "ü" * 40), (6, "HTTPS://u@Ex.org:8/p?q#f", "ü" * 60), (7, "x", ""), (8, "http://a.example.com\n", big)]
    rows += [(k, f"http://h{k % 7}.example.net/{k}", f"page {k % 50} " * 30) for k in range(100, 1700)]
    pages = spark.createDataFrame([(*r, "z", 7, "k") for r in rows], "page_id long, url string, html string, payload_digest string, part int, cap_key string")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(rows)
    first = {}
    for k, _, h in sorted(rows, key=lambda r: r[0]):
        data = (h or "").encode()
        own = first.setdefault(data, k) if len(data) >= 100 else k
        r = got[k]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(data), hashlib.sha256(data).hexdigest(), "response" if own == k else "revisit", None if own == k else own)
        assert own != k or bytes(r["payload"]) == data
    assert warc.round_trip(pages.where("false")).count() == 0
    odd = spark.createDataFrame([("", "http://a", big), (None, "http://a", big), ("a b%\n", None, "ü" * 60), ("a b%\n", None, "ü" * 60), ("z", "http://a", big)], "page_id string, url string, html string")
    back = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(odd).collect()), key=str)
    assert back == sorted([("", "response", None), (None, "revisit", ""), ("a b%\n", "response", None), ("a b%\n", "response", None), ("z", "revisit", "")], key=str)
    assert warc.capture_key("https://blog.Example.com:81/a?b#c") == "com,example,blog:81)/a?b" and warc.capture_key(None) == ""


def test_merkle_trees_and_edits(spark, docs, nothing):
    got = {r["doc_id"]: r for r in merkle.compare_with_edit(docs).collect()}
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert merkle.compare_with_edit(docs).count() == len(rows)
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edit = t[: len(t) - half] + nxt[:half]
        if i != 2:
            assert got[i]["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest() and got[i]["n_chars"] == len(t)
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and got[1]["near_next"] == 1.0 and 0 < got[1]["near_edited"] < 1 + 1e-9
    assert merkle.compare_with_edit(nothing).count() == 0
    before = "\n".join(f"paragraph {k}" for k in range(30))
    a = spark.createDataFrame([(1, before), (2, "same")], "doc_id long, text string")
    b = spark.createDataFrame([(1, before.replace("paragraph 17", "other") + "\nmore"), (2, "same")], "doc_id long, text string")
    edits = merkle.locate_edits(merkle.trees(a), merkle.trees(b)).orderBy("paragraph").collect()
    assert [(r["doc_id"], r["section"], r["paragraph"], r["change"]) for r in edits] == [(1, 2, 17, "edited"), (1, 3, 30, "added")]


def test_next_document_over_many_ranges(spark):
    ids = sorted({(k * 7919) % 100_003 for k in range(700)})
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["next_text"] for r in merkle.with_next(df, chunk_rows=10).collect()}
    assert got == {i: f"t{ids[(k + 1) % len(ids)]}" for k, i in enumerate(ids)}
    assert re.fullmatch("t\\d+", got[ids[-1]])
    far = spark.createDataFrame([(f"id{i:06d}", f"t{i}") for i in [*ids, 999_999]] + [(None, f"n{k}") for k in range(90)] + [("id000000", f"s{k}") for k in range(80)], "doc_id string, text string")
    rows = merkle.with_next(far, chunk_rows=10)
    assert rows.count() == len(ids) + 171 and sorted(r["next_text"] for r in rows.collect()) == sorted(r["text"] for r in far.collect())
    got = {r["doc_id"]: r["next_text"] for r in rows.collect()}
    assert all(got[f"id{i:06d}"] == f"t{j}" for i, j in zip(ids, ids[1:], strict=False) if i) and got["id999999"][0] == "n"


def leaves(line):
    """The leaves of a line by the rule, with Python's own expressions."""
    import regex

    out = []
    for piece in [m[0] for m in regex.finditer(merkle.CLAUSE, line)]:
        out += [m[0] for m in regex.finditer(merkle.FURTHER, piece)] if len(piece) > merkle.LONG else [piece]
    assert "".join(out) == line
    return out


def tree(text):
    """The root and the nodes with their weights, those that repeat as often as they stand."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    c = [[(sha(x), len(x)) for x in leaves(line)] for line in (text or "").split("\n")]
    p = [sha("".join(f"{d}{n}" for d, n in x)) for x in c]
    s = [sha("".join(p[k : k + 8])) for k in range(0, len(p), 8)]
    root = sha("".join(s))
    return root, Counter([(d, 1) for d in (root, *s, *p)] + [y for x in c for y in x])


def alike(x, y):
    weight = lambda c: sum(n * k for (_, n), k in c.items())
    return 2 * weight(x & y) / (weight(x) + weight(y))


def test_likeness_goes_through_the_tree(spark):
    rows = [(1, "One, two. Three\n\nFour; five!"), (2, "One, two. Three\n\nFour; six!"), (3, "two. One, Three\n\nFour; six!"), (4, ""), (5, None), (6, "a\u0001b \u0002c the"), (7, "ab \u0001\u0002c the"), (8, "Thea " * 60 + "orn " * 60), (9, "Thea " * 30 + "orn " * 60), (10, "x" * 300 + "e" + "y" * 90), (11, "x" * 300 + "e" + "z" * 90)]
    got = {r["doc_id"]: r for r in merkle.compare_with_edit(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (i, text) in enumerate(rows):
        (a, x), (_, y) = tree(text), tree(rows[(k + 1) % len(rows)][1])
        assert got[i]["fingerprint"] == a and abs(got[i]["near_next"] - alike(x, y)) < 1e-12, i
    assert 0 < got[2]["near_next"] < 1 and got[4]["near_next"] == 1.0 and got[6]["fingerprint"] != got[7]["fingerprint"]


def test_half_of_a_text_is_about_half_alike_in_any_script(spark):
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшы", "αβγδεζηθικλμνξοπρστυφχψω", "अआइईउऊएऐओऔकखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह", "的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可她里后小么心多天而能好都然没日于起还发成事只作当想看文无开手十用主行方又如前所本见经头面公同三已老从动两长"]
    rows = []
    for k in range(60):
        letters = alphabets[k % 5]
        text = " ".join(word(letters) for _ in range(120)) if k % 5 != 4 else "".join(word(letters) for _ in range(80))
        rows.append((k, text.upper() if k % 10 == 5 else text.replace(" ", "!! ") if k % 10 == 0 else text))
    rows += [(100, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(2000))), (101, "la " * 400), (102, "no end in\n" * 60)]
    got = {r["doc_id"]: r for r in merkle.compare_with_edit(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r["near_edited"] > 0.3 for r in got.values()), sorted((r["near_edited"], i) for i, r in got.items())[:3]
    assert all(got[k]["near_next"] < 0.2 for k in range(59))


def test_pipeline_equals_brute_force(spark, tmp_path):
    import duckdb

    import corpus_pipeline
    from panelyard.llm import language, toxicity

    rng = random.Random(5)
    rows = [(k, f"the words of document {k} and the {'bad blorgh snarf' if k % 9 == 0 else f'good thing{k}'} with some more of {k * 31 % 97} them", "en", f"s{k % 3}", 50) for k in range(1, 200)]
    rows += [(500 + k, rows[4][1], "en", "s1", 50) for k in range(5)] + [(900, None, None, None, None), (901, "123", "en", "s0", 3)]
    base = [" ".join(rng.choices([f"w{k}" for k in range(400)], k=120)) for _ in range(12)]
    for k, t in enumerate(base):  # near copies on both sides of 0.8
        for j, n in enumerate((0, 1, 2, 4, 9)):
            words = t.split()
            for at in rng.sample(range(120), n):
                words[at] = "changed"
            rows.append((1000 + 10 * k + j, "the and of them " + " ".join(words), "en", "s2", 600))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 9 == 0)) for k in range(1, 200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen, given = {}, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given[name] = docs
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = docs = docs.cache()
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    scored = toxicity.score(given["toxicity"], toxicity.fit(toxicity.training_rows(given["toxicity"], labels), given["toxicity"]))
    assert ids(seen["toxicity"]) == ids(scored.where("predicted = 0")) and seen["toxicity"].where("doc_id % 9 = 0 AND doc_id < 200").count() == 0
    told = language.identify(given["language_id"], language.fit(language.training_rows(given["language_id"])))
    assert ids(seen["language_id"]) == ids(told.where("accepted")) and not {900, 901} & set(ids(seen["language_id"]))
    texts = {r["doc_id"]: r["text"] for r in given["simhash_near_dedup"].collect()}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in texts.items() for w in [t.split()]}
    group = {i: i for i in texts}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    order = sorted(texts)
    for k, i in enumerate(order):
        for j in order[:k]:
            if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                a, b = top(i), top(j)
                group[max(a, b)] = min(a, b)
    kept = sorted(i for i in order if top(i) == i)
    assert ids(seen["simhash_near_dedup"]) == kept and not {500, 501, 1001} & set(kept) and 1004 in kept
    con = duckdb.connect()
    documents = seen["simhash_near_dedup"].toPandas()  # noqa: F841  DuckDB reads it by name
    want = {r[0]: r[1] for r in con.sql(f"SELECT doc_id, copies FROM ({mixing.MIX_SQL})").fetchall()}
    assert Counter(ids(seen["mixing"])) == Counter({i: n for i, n in want.items() if n})
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by_doc, _ = whole(packed, sum(p["length"] for p in packed))
    assert {i: sum(p["length"] for p in ps) for i, ps in by_doc.items()} == {i: want[i] * ps[0]["doc_tokens"] for i, ps in by_doc.items()} and set(by_doc) == {i for i, n in want.items() if n}
