import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panelyard.llm import html_text, language, toxicity, wordpiece


def test_language_on_held_out_rows_and_edge_cases(spark, docs, nothing):
    en = ["the cat and the dog went to the house with them", "this is what they would have wanted from that thing", "there was nothing other than the weather to think about"]
    de = ["der hund und die katze gingen mit ihnen in das haus", "das ist was sie von diesem ding gewollt hätten", "es gab nichts anderes als das wetter zum nachdenken"]
    rows = [(k, (en if k % 2 else de)[k // 2 % 3] + " " + (en if k % 2 else de)[k % 3], "en" if k % 2 else "de") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dicts = language.fit(language.training_rows(df))
    assert sorted(dicts) == ["de", "en"]
    got = {r["doc_id"]: r for r in language.identify(df, dicts).collect()}
    assert all(got[k]["lang_pred"] == lang and 0 <= got[k]["score"] <= 1 for k, _, lang in rows)
    edge = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, dicts).collect()}
    assert edge[3] == edge[4] == edge[5] == edge[8] == "und" and edge[7] == "de" and edge[1] in dicts
    assert language.identify(docs, language.fit(nothing)).where("lang_pred <> 'und'").count() == 0
    assert language.fit(nothing) == {} and language.identify(nothing, dicts).count() == 0
    import zstandard

    def size(content, data):  # one frame a block, by a dictionary made anew each time
        made = lambda: zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
        return sum(len(made().compress(data[at : at + 8192])) for at in range(0, len(data), 8192))

    for r in docs.collect():
        if data := language.plain(r["text"]).encode():
            sizes = sorted((size(content, data), lang) for lang, content in dicts.items())
            same = [x for x in language.identify(docs.where(docs.doc_id.eqNullSafe(r["doc_id"])), dicts).collect()]
            assert all(x["lang_pred"] == sizes[0][1] and abs(x["margin"] - (sizes[1][0] - sizes[0][0]) / sizes[1][0]) < 0.02 for x in same)
    odd = spark.createDataFrame([(1, "½ ² ①"), (2, "\u0301\u0302 12"), (3, "हिन्दी भाषा"), (4, "١٢٣ 45"), (5, "ª"), (6, "Ünï-CÖDE")], "doc_id long, text string")
    told = {r["doc_id"]: (r["lang_pred"], r["score"], r["accepted"]) for r in language.identify(odd, dicts).collect()}
    assert told[1] == told[2] == told[4] == ("und", 0.0, False) and all(told[k][0] in dicts for k in (3, 5, 6))
    assert language.plain("हिन्दी, भाषा 12½x") == "हिन्दी भाषा x" and language.plain("A1b") == "a b"
    kept = language.keep_known(docs, dicts)
    assert kept.columns == docs.columns and {3, 4, 5, 8}.isdisjoint(r["doc_id"] for r in kept.collect())


@pytest.fixture
def labelled(spark):
    rows, labels = [], []
    for k in range(400):
        bad = k % 8 == 0
        rows.append((k, f"word{k % 13} plain{k % 7} thing{k % 11} " + (f"blorgh{'abc'[k % 3]} snarf{k % 2}" if bad else f"other{k % 5}")))
        labels.append((k, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_finds_held_out_rows(spark, labelled, docs, nothing):
    texts, labels = labelled
    index = toxicity.fit(toxicity.training_rows(texts, labels), texts)
    got = {r["doc_id"]: r for r in toxicity.score(texts, index).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert held and all(got[k]["predicted"] == int(k % 8 == 0) for k in held)
    assert got[8]["evidence"] and all(e["toxic"] == 1 for e in got[8]["evidence"])
    edge = toxicity.score(docs, index).collect()
    assert len(edge) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in edge)
    assert toxicity.score(nothing, index).count() == 0
    assert toxicity.keep_clean(docs, index).count() == docs.count()
    none = toxicity.fit(toxicity.training_rows(texts, labels.where("toxic = 0")), texts)
    assert toxicity.score(docs, none).where("predicted = 1").count() == 0
    empty = toxicity.fit(toxicity.training_rows(texts, labels.where("false")), texts)
    assert toxicity.score(docs, empty).where("score <> 0 OR size(evidence) > 0").count() == 0


def by_hand(rows, corpus):
    """Weights, unit vectors, labels and ids of examples, from dictionaries alone."""
    read = lambda t: Counter(f for w in t.lower().split() for f in toxicity.word_features(w))
    counts, n = [read(t) for _, t, _ in rows], len(rows)
    texts = [read(t) for t in corpus]
    n1 = sum(y for _, _, y in rows)

    def term(x, row, col):
        return x * math.log(x * n / (row * col)) if x else 0.0

    weights = {}
    for f in {f for c in counts for f in c}:
        held, toxic = sum(f in c for c in counts), sum(f in c and y for c, (_, _, y) in zip(counts, rows, strict=True))
        g = 2 * (term(toxic, held, n1) + term(held - toxic, held, n - n1) + term(n1 - toxic, n - held, n1) + term(n - n1 - held + toxic, n - held, n - n1))
        weights[f] = math.log(1 + len(texts) / max(1, sum(f in c for c in texts))) * (1 + math.sqrt(max(0, g)))

    def unit(c):
        v = {f: (1 + math.log(k)) * weights[f] for f, k in c.items() if f in weights}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {f: x / norm for f, x in v.items()}

    return [unit(c) for c in counts], lambda t: unit(read(t))


def test_toxicity_neighbours_equal_a_full_scan(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(30)] + [f"longer{k}word" for k in range(60)] + ["Stem" + "xyz"[k % 3] * k for k in range(1, 12)] + [f"r{k}" for k in range(1500)]
    rows = [(f"d{k}", " ".join(rng.choices(words, k=rng.randint(1, 60))) + ("!" if k % 2 else " (vile)" if k % 6 == 0 else ""), int(k % 6 == 0)) for k in range(500)]
    queries = [" ".join(rng.choices(words, k=rng.randint(1, 90))) for _ in range(60)] + ["", "nothing known", "vile", rows[6][1]]
    df = spark.createDataFrame(rows, "doc_id string, text string, toxic int").repartition(5)
    corpus = spark.createDataFrame([(t,) for _, t, _ in rows] + [(t,) for t in queries], "text string")
    index = toxicity.fit(df, corpus)
    assert len(index.labels) == 500 and len(index.weights) - index.first > 1 and index.first > 1000
    vectors, unit = by_hand(rows, [t for _, t, _ in rows] + queries)
    place = {i: k for k, i in enumerate(index.ids.to_pylist())}
    for text, (cosine, at) in zip(queries, index.nearest(pa.array(queries)), strict=True):
        q = unit(text)
        full = sorted(((sum(x * v.get(f, 0) for f, x in q.items()), -place[rows[k][0]]) for k, v in enumerate(vectors)), reverse=True)
        want = [s for s, _ in full if s > 0][:15]
        assert np.allclose(cosine, want, atol=1e-9) and len(at) == len(want)
        share = (sum(c * index.labels[p] for c, p in zip(cosine, at, strict=True)) + 0.05 * index.prior) / (sum(cosine) + 0.05)
        assert abs(index.share(cosine, at) - share) < 1e-12
    got = {r["text"]: r for r in toxicity.score(spark.createDataFrame([(t, t) for t in queries], "doc_id string, text string"), index).withColumnRenamed("doc_id", "text").collect()}
    assert got["vile"]["predicted"] == 1 and all(e["toxic"] == 1 for e in got["vile"]["evidence"]) and got[""]["evidence"] == []
    assert got[rows[6][1]]["evidence"][0]["doc_id"] == "d6" and abs(got[rows[6][1]]["evidence"][0]["cosine"] - 1) < 1e-9
    assert got[""]["score"] == got["nothing known"]["score"] < 0.5


def test_automaton_equals_greedy_search(spark, docs, nothing):
    pieces = wordpiece.vocabulary()
    known, longest, automaton = set(pieces), max(map(len, pieces)), wordpiece.Automaton(pieces)

    def greedy(word):
        n = at = 0
        while at < len(word):
            for k in range(min(longest, len(word) - at), 0, -1):
                if word[at : at + k] in known:
                    at, n = at + k, n + 1
                    break
            else:
                n, at = n + len(word[at].encode()), at + 1
        return n

    words = "▁internationalization ▁über ▁x ▁ ▁日本語 ▁😀!! ▁aaaaaaaaaaaaaaaaaaaaa ▁thhaen ▁ciónmente ▁SHOUTING ▁1234567".split(" ")
    assert [automaton.count(w) for w in words] == [greedy(w) for w in words]
    got = {r["doc_id"]: r for r in wordpiece.token_counts(docs).collect()}
    assert got[3]["n_tokens"] == got[4]["n_tokens"] == got[5]["n_tokens"] == 0
    assert got[6]["n_words"] == 60_000 and got[1]["n_tokens"] == sum(greedy("▁" + w) for w in "The quick brown fox. It jumps over, the lazy dog! Second line here.".split())
    assert wordpiece.token_counts(nothing).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><nav><ul><li><a href=x>Home</a></li></ul></nav></header>
<article><h1>The  title</h1><p><b>First paragraph &amp; words,
that go on for a while.<br><p>Second paragraph.</p></article><div class="ad">Buy this now</div><section class="comments"><p>I liked this a lot, thank you.</p></section><form><p>Sign up today</p></form><footer>&copy; someone</footer></body></html>"""


def test_blocks():
    got = html_text.blocks(PAGE)
    assert [b[1] for b in got] == ["T", "Home", "The title", "First paragraph & words, that go on for a while.", "Second paragraph.", "Buy this now", "I liked this a lot, thank you.", "Sign up today", "© someone"]
    assert html_text.blocks(None) == html_text.blocks("  ") == []
    assert html_text.blocks("<p class='a>b<p>c < d")[-1][1].endswith("c < d")
    script = "<script>if (a<b) { // don't\n}</script><p class='x'>Text one</p><p>It's fine</p>"
    assert [b.text for b in html_text.blocks(script)] == ["Text one", "It's fine"]
    assert html_text.blocks("<p>if a <b and don't</p><p>Second it's</p>")[-1].text == "Second it's"
    assert html_text.blocks('<p title="a > b" class=x>in</p>')[0] == ((("p", "x"),), "in", 0, (1,))


def test_gradients_are_those_of_the_loss():
    import numpy as np

    rng = np.random.default_rng(0)
    net = html_text.BiLSTM(5, hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = html_text.padded([rng.normal(size=(4, 5)).astype(np.float32), rng.normal(size=(2, 5)).astype(np.float32)])
    y = (rng.random(mask.shape) < 0.5).astype(np.float32)

    def loss():
        p = net.forward(x, mask)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    for k, g in net.gradients(x, mask, y).items():
        at = tuple(int(rng.integers(s)) for s in net.p[k].shape)
        old, e = net.p[k][at], 1e-3
        net.p[k][at] = old + e
        up = loss()
        net.p[k][at] = old - e
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / (2 * e) - g[at]) < 2e-3


def page(k, scramble=False):
    """A page of a site whose menu, advert and footer repeat; the article's own text differs from page to page."""
    rng = random.Random(k)
    say = lambda n: " ".join("".join(rng.choices("aeioustrnlm", k=rng.randint(2, 8))) for _ in range(n)).capitalize() + "."
    title, parts = say(6), [say(rng.randint(15, 60)) for _ in range(rng.randint(2, 7))]
    body = "<header><nav><ul>" + "".join(f"<li><a href=/{w}>{w}</a></li>" for w in ("Home", "News", "About us")) + f'</ul></nav></header><div class="ad">Buy thing number {k % 3} now, it is cheap.</div>'
    body += f"<article><h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in parts) + f"</article><footer>&copy; A site, part {k % 4}. All rights.</footer>"
    if scramble:
        for tag in ("header", "nav", "article", "footer"):
            body = body.replace(f"<{tag}>", "<div>").replace(f"</{tag}>", "</div>")
        body = body.replace(' class="ad"', "")
    return f"<html><head><title>{title}</title><script>var t='</p>';</script></head><body>{body}</body></html>", "\n".join([title, *parts])


def test_extraction_with_and_without_telling_tags(spark):
    schema = "page_id long, url string, html string, text string, blocks string, n_chars int"
    for scramble in (False, True):
        rows = [(k, f"http://x/{k}", page(k, scramble)[0]) for k in range(60)] + [(90, None, None), (91, "u", ""), (92, "u", "plain text only"), (None, None, page(1, scramble)[0]), (7, "http://x/7", page(7, scramble)[0])]
        got = html_text.extract(spark.createDataFrame([(*r, "t", "b", 1) for r in rows], schema)).collect()
        assert len(got) == len(rows) and got[0].__fields__ == ["page_id", "url", "text", "n_chars"]
        by_id = {r["page_id"]: r for r in got}
        equal = sum(by_id[k]["text"] == page(k)[1] for k in range(60))
        assert equal >= (60 if not scramble else 54), (scramble, equal)
        assert by_id[90]["text"] == by_id[91]["text"] == "" and by_id[90]["n_chars"] == 0 and all(r["n_chars"] == len(r["text"]) for r in got)
        assert by_id[None]["text"] == by_id[1]["text"]
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0


def test_batches_do_not_change_a_page(spark):
    """Every page by itself through the net, cell by cell, against the operator's padded batches; one page is very long."""
    texts = [page(k)[0] for k in range(30)] + ["<p>" + "</p><p>".join(f"word {k} of many" for k in range(3000)) + "</p>"]
    net = html_text.train([html_text.blocks(h) for h in texts[:30]], rounds=20)
    sig = lambda z: 1 / (1 + np.exp(-z))
    got = {r["page_id"]: r["blocks"] for r in html_text.label(spark.createDataFrame([(k, "u", h) for k, h in enumerate(texts)], "page_id long, url string, html string"), net).collect()}
    for k, h in enumerate(texts):
        x, states = html_text.features(html_text.blocks(h)).astype(float), {}
        for d, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
            hid, cell = np.zeros(net.h), np.zeros(net.h)
            for at in order:
                i, f, o, u = np.split(x[at] @ net.p["W" + d] + hid @ net.p["U" + d] + net.p["c" + d], 4)
                cell = sig(f) * cell + sig(i) * np.tanh(u)
                hid = sig(o) * np.tanh(cell)
                states[d, at] = hid
        want = [float(sig(np.concatenate([states["f", at], states["b", at]]) @ net.p["v"] + net.p["o"][0])) for at in range(len(x))]
        assert np.allclose([b["main"] for b in got[k]], want, atol=1e-3)


def article_pages(n, wrap="<p>{}</p>", around="<article>{}</article>", below=""):
    """Pages of one site with articles of their own, copies of the first among them, and the text of every article's blocks."""
    rng = random.Random(9)
    made = lambda k: " ".join(rng.choice(["river", "stone", "bend", "water", "field", "grass", "cloud"]) + str(rng.randrange(60)) for _ in range(k))
    pages, texts = [], []
    for k in range(n):
        paragraphs = [f"Title {k} {made(3)}"] + [made(rng.randint(8, 40)) + "." for _ in range(rng.randint(2, 6))] if k % 7 or not k else texts[0]
        body = "".join(wrap.format(p) for p in paragraphs)
        pages.append("<html><body><nav><a href=/>Home</a><a href=/b>About us</a></nav><div class=ad>Buy it now " + made(2) + "</div>" + around.format(body) + below.format(a=made(1), b=made(6)) + "<footer>All rights reserved by the site</footer></body></html>")
        texts.append(paragraphs)
    return pages, texts


@pytest.mark.parametrize("shape", [{}, {"wrap": "<div><p>{}</p></div>"}, {"wrap": "<section><div><p>{}</p></div></section>"}, {"wrap": "<div><p>{}</p></div>", "around": "<div><div>{}</div></div>"}, {"below": "<section><h3>Comments</h3><ul><li><b>{a}</b><p>{b}</p></li><li><b>{a}</b><p>{b} yes</p></li></ul></section>"}])
def test_labels_whatever_holds_the_paragraphs(shape):
    pages, texts = article_pages(60, **shape)
    leaves = [html_text.blocks(p) for p in pages]
    labelled = [[b.text for b, y in zip(leaf, kinds, strict=True) if y] for leaf, kinds in zip(leaves, html_text.structural_labels(leaves), strict=True)]
    right = sum(len(set(g) & set(w)) for g, w in zip(labelled, texts, strict=True))
    assert right >= 0.95 * sum(map(len, labelled)) and right >= 0.95 * sum(len(set(w)) for w in texts)


def test_copies_of_a_page_count_as_one():
    leaves = [html_text.blocks(p) for p in article_pages(30)[0]]
    first = html_text.originals(leaves)
    assert {first[k] for k in range(0, 30, 7)} == {0} and len(set(first)) == 30 - 4


def test_readers_remarks_are_left_out():
    pages, texts = article_pages(80)
    net = html_text.train([html_text.blocks(p) for p in pages])
    shape = "<div><h3>Comments</h3><div>{a}</div><div>{b}</div><div>Ann</div><div>I do not think so {a}</div></div>"
    kept = extra = missed = 0
    for page, want in zip(*article_pages(80, below=shape), strict=True):
        leaf = html_text.blocks(page)
        got = Counter(b.text for b, v in zip(leaf, net.forward(*html_text.padded([html_text.features(leaf)]))[:, 0], strict=True) if v >= 0.5)
        kept += sum((got & Counter(want)).values())
        extra += sum((got - Counter(want)).values())
        missed += sum((Counter(want) - got).values())
    assert 2 * kept / (2 * kept + extra + missed) >= 0.95, (kept, extra, missed)
