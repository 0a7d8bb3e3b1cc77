"""Near-duplicates: SimHash by covering locality-sensitive hashing, and one of each group of similar texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import connected_components, cut, map_arrow, row_hash, whole_row

BITS = 64


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """Adds ``fingerprint`` (the 64 bits as a signed long) to ``doc_id``.

    A-Z are lower-cased, words are runs without ASCII white space, and every
    shingle of ``shingle`` words counts as often as it occurs. A null or blank
    text has no shingle and gets fingerprint 0; a text of fewer words is one
    shingle. Texts are read whole; shingles are counted in blocks, so memory
    does not grow with a text beyond its own words.
    """

    def start():
        import numpy as np
        import xxhash

        digest = xxhash.xxh64_intdigest

        def of(value):
            words = (value or "").encode("utf-8", "surrogatepass").lower().split()
            if not words:
                return 0
            if len(words) < shingle:
                hashes = [digest(b" ".join(words), seed)]
            else:
                hashes = [digest(b" ".join(s), seed) for s in zip(*(words[k:] for k in range(shingle)), strict=False)]
            h, ones = np.array(hashes, dtype="<u8"), np.zeros(BITS, dtype=np.int64)
            for at in range(0, len(h), 65536):
                ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])

        return lambda batch: [batch.column(0), [of(t) for t in batch.column(1).to_pylist()]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", text), start, f"doc_id {kind}, fingerprint long")


def covering_masks(radius: int) -> list[int]:
    """``2**(radius+1) - 1`` bit masks that cover every pair within ``radius``.

    Bit i carries a nonzero vector m(i) of ``radius + 1`` bits; mask v keeps the
    bits with odd <m(i), v>. For any ``radius`` differing bits, some v is
    orthogonal to all their vectors, so that mask drops every one of them and
    the pair agrees on what is left.
    """
    n = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(BITS) if bin((i % n + 1) & v).count("1") % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprint_links(distinct: DataFrame, radius: int = 2, bucket: int = 256) -> DataFrame:
    """Links (src, dst) whose closure joins all fingerprints within ``radius`` bits.

    ``distinct`` has one row for each ``fingerprint``. Each is put in one bucket
    of every covering table. A bucket of at most ``bucket`` members is compared
    pair by pair inside the join. A larger one is not compared at all: each
    member also stands at its neighbours on the bits its mask dropped, and those
    that meet at one neighbour hang on the smallest of them. With radius 2 that
    is exact (two meet exactly if they differ in at most 2 bits) and linear.
    """
    if radius != 2:
        raise ValueError("large buckets are exact for radius 2 only")
    masks = covering_masks(radius)
    keys = F.array(*[F.struct(F.lit(k).alias("tab"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])
    placed = distinct.select("fingerprint", F.explode(keys).alias("at")).select("fingerprint", "at.tab", "at.key")
    sizes = placed.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = cut(placed.join(sizes, ["tab", "key"]), "simhash-buckets")
    small = shared.where(F.col("members") <= bucket)
    a, b = small.alias("a"), small.alias("b")
    apart = F.bit_count(F.col("a.fingerprint").bitwiseXOR(F.col("b.fingerprint")))
    pairs = a.join(b, (F.col("a.tab") == F.col("b.tab")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fingerprint") < F.col("b.fingerprint")) & (apart <= radius)).select(F.col("a.fingerprint").alias("src"), F.col("b.fingerprint").alias("dst"))
    free = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(BITS) if not m >> i & 1]) for m in masks])
    stood = shared.where(F.col("members") > bucket).select("fingerprint", F.explode(F.element_at(free, F.col("tab") + 1)).alias("flip")).select("fingerprint", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("z")).distinct()
    hubs = stood.groupBy("z").agg(F.min("fingerprint").alias("dst"), F.count(F.lit(1)).alias("n")).where("n > 1").select("z", "dst")
    hung = stood.join(hubs, "z").where("fingerprint <> dst").select(F.col("fingerprint").alias("src"), "dst")
    return pairs.union(hung).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id``, ``fingerprint`` (long) and ``component_id``, one row for each row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links of at most
    ``radius`` differing bits, the row's own included. Repeated rows and equal
    texts share a fingerprint and therefore a component; rows with a null
    ``doc_id`` take part and get the smallest non-null id (null if there is
    none). An empty table gives an empty result; other columns are ignored.
    """
    prints = cut(fingerprints(docs, text, shingle), "simhash")
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    comps = connected_components(fingerprint_links(distinct.select("fingerprint"), radius), "simhash-components")
    joined = distinct.join(comps, distinct.fingerprint == comps.node, "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("root"))
    best = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    lookup = joined.join(best, "root").select("fingerprint", "component_id")
    return prints.join(lookup, "fingerprint").select("doc_id", "fingerprint", "component_id")


def sketches(docs: DataFrame, text: str = "text", shingle: int = 5, rows: int = 6, bands: int = 24) -> DataFrame:
    """``node`` (hash of the text), ``n`` (its distinct shingles) and ``keys``, a long for each band of ``rows`` least hashes.

    Two texts of Jaccard similarity j share a key with probability
    1 - (1 - j^rows)^bands: 0.999 at 0.8 with the defaults, and more above. The
    64 bits of a SimHash cannot do that: at 0.8 about ten of them differ, and
    bands that still agree hold too few bits to part unrelated texts.
    """

    def start():
        import numpy as np
        import xxhash

        of = hashed_shingles(shingle)
        rng = np.random.default_rng(7)
        a, b = rng.integers(0, 2**63, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, rows * bands, dtype=np.uint64)

        def keys(h):
            least = np.full(rows * bands, 2**64 - 1, dtype=np.uint64)
            for at in range(0, len(h), 2048):
                least = np.minimum(least, (h[at : at + 2048, None] * a + b).min(axis=0))
            return [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(bands, rows))]

        def step(batch):
            sets = [of(t) for t in batch.column(1).to_pylist()]
            return [batch.column(0), [len(h) for h in sets], [np.array(keys(h), dtype=np.uint64).view(np.int64).tolist() for h in sets]]

        return step

    return map_arrow(docs.select(text_node(text).alias("node"), text), start, "node long, n long, keys array<long>")


#: Texts of a bucket whose pairs may become rows; texts of a block of a larger one; shingles that a task's matrices hold at once.
FEW, BLOCK, COLUMNS = 48, 256, 8_192


def text_node(text: str) -> Column:
    """The hash by which equal texts are one node; a null text is an empty one."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def hashed_shingles(shingle: int):
    """A function from a text to the sorted distinct 64-bit hashes of its shingles, with words as in ``fingerprints``."""
    import numpy as np
    import xxhash

    def of(value):
        words = (value or "").encode("utf-8", "surrogatepass").lower().split()
        if len(words) < shingle:
            hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else []
        else:
            hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in zip(*(words[k:] for k in range(shingle)), strict=False)]
        return np.unique(np.array(hashes, dtype=np.uint64))

    return of


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (src, dst) of ``pairs`` whose shingle sets have a Jaccard similarity of at least ``similarity``."""

    def start():
        import numpy as np

        def step(batch):
            out = [], []
            for src, dst, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                    out[0].append(src)
                    out[1].append(dst)
            return list(out)

        return step

    a, b = sets.select(F.col("node").alias("src"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("dst"), F.col("hashes").alias("y"))
    return map_arrow(pairs.join(a, "src").join(b, "dst").select("src", "dst", "x", "y"), start, "src long, dst long")


def block_links(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (src, dst) that join the components of large buckets; ``rows`` has key, node, comp and the bucket's ``main`` component.

    A bucket's texts are cut by a hash into blocks of about BLOCK, those of the
    main component apart; every two blocks meet in one task unless both are of
    the main one. A task counts common shingles of its two blocks by products of
    0/1 matrices, some thousand shingles at a time, and returns a spanning
    forest of the links between different components.
    """
    own = F.col("comp") == F.col("main")
    size = rows.groupBy("key").agg(F.ceil(F.count_if(own) / BLOCK).alias("mains"), F.ceil(F.count_if(~own) / BLOCK).alias("rest"))
    spot = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1)))
    placed = rows.join(size, "key").withColumn("own", F.when(own, spot(F.col("mains"))).otherwise(F.col("mains") + spot(F.col("rest"))))
    meets = F.sequence(F.when(own, F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("rest") - 1)
    dealt = placed.select("key", "node", "comp", "own", F.explode(meets).alias("with")).select("key", "node", "comp", "own", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"))

    def meet(table: pa.Table) -> pa.Table:
        import numpy as np

        node, comp, own, lo = (table.column(c).to_numpy() for c in ("node", "comp", "own", "lo"))
        hashes = [np.frombuffer(x, dtype="<u8") for x in table.column("hashes").to_pylist()]
        n = np.array([len(h) for h in hashes])
        ax = np.flatnonzero(own == lo)
        by = ax if table.column("hi")[0].as_py() == lo[0] else np.flatnonzero(own != lo)
        _, col, seen = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(n)), n)
        shared = seen[col] > 1
        row, col = row[shared], np.unique(col[shared], return_inverse=True)[1]
        both = np.zeros((len(ax), len(by)))
        for at in range(0, int(col.max(initial=-1)) + 1, COLUMNS):
            inside = (col >= at) & (col < at + COLUMNS)
            x = np.zeros((len(n), COLUMNS), dtype=np.float32)
            x[row[inside], col[inside] - at] = 1
            both += x[ax] @ x[by].T
        hit = both >= similarity * (n[ax][:, None] + n[by][None, :] - both) - 1e-9
        hit &= comp[ax][:, None] != comp[by][None, :]
        up: dict[int, int] = {}

        def top(c):
            while up.get(c, c) != c:
                c = up[c]
            return c

        src, dst = [], []
        for i, j in zip(*np.nonzero(hit), strict=True):
            p, q = top(int(comp[ax[i]])), top(int(comp[by[j]]))
            if p != q:
                up[max(p, q)] = min(p, q)
                src.append(int(node[ax[i]])), dst.append(int(node[by[j]]))
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return dealt.join(sets, "node").groupBy("key", "lo", "hi").applyInArrow(meet, "src long, dst long")


def simhash_buckets(docs: DataFrame, text: str = "text", shingle: int = 5, radius: int = 2) -> DataFrame:
    """(node, key): texts whose fingerprints are joined by links of at most ``radius`` bits share a key."""
    named = docs.select(text_node(text).alias("doc_id"), text)
    prints = cut(fingerprints(named, text, shingle).select(F.col("doc_id").alias("node"), "fingerprint").distinct(), "near-simhash")
    comps = connected_components(fingerprint_links(prints.select("fingerprint").distinct(), radius), "near-simhash-components")
    roots = prints.join(comps.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("component", "fingerprint"))
    return roots.select("node", F.xxhash64(F.lit("simhash"), "root").alias("key"))


def similar_links(docs: DataFrame, text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Components (node, component) of the texts under exact Jaccard similarity of at least ``similarity``.

    Candidates share a SimHash component (``simhash_buckets``) or a band key:
    SimHash holds the nearest copies together, bands those beyond its few bits,
    and the exact check follows for both. First every text of a bucket is compared with
    the bucket's least, which joins large groups in linear work; then all pairs
    of a bucket whose two texts are still in different components: in a bucket of
    up to FEW texts as rows, in a larger one block by block inside the tasks
    (``block_links``), so that no pair of a large group becomes a row. A pair is
    left out only if it is in one component already, was compared, or its sizes
    alone rule the similarity out.
    """
    known = cut(sketches(docs, text, shingle).distinct(), "near-sketches")
    close = simhash_buckets(docs, text, shingle).join(known.select("node", "n"), "node").select("node", "n", "key")
    placed = known.select("node", "n", F.explode("keys").alias("key")).union(close)
    buckets = placed.groupBy("key").agg(F.min("node").alias("rep"), F.max("node").alias("last")).where("rep < last").select("key", "rep")
    shared = cut(placed.join(buckets, "key"), "near-buckets")
    nodes = shared.select("node").distinct()

    def start():
        of = hashed_shingles(shingle)
        return lambda batch: [batch.column(0), [of(t).tobytes() for t in batch.column(1).to_pylist()]]

    texts = docs.select(text_node(text).alias("node"), text).join(nodes, "node", "left_semi").dropDuplicates(["node"])
    sets = cut(map_arrow(texts, start, "node long, hashes binary"), "near-sets")
    stars = cut(shared.where("node <> rep").select(F.col("node").alias("src"), F.col("rep").alias("dst")).distinct(), "near-stars")
    first = cut(similar_pairs(stars, sets, similarity), "near-links")
    joined = connected_components(first, "near-components")
    held = cut(shared.join(joined, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("comp")), "near-held")
    mixed = held.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    left = cut(held.join(mixed, "key"), "near-mixed")
    count = left.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min_by("comp", "node").alias("main"))
    few = left.join(count.where(F.col("size") <= FEW).select("key"), "key")
    comps = few.select("key", "comp").distinct()
    two = comps.join(comps.select("key", F.col("comp").alias("other")), "key").where("comp < other")
    a, b = few.select("key", "comp", F.col("node").alias("p"), F.col("n").alias("pn")), few.select("key", F.col("comp").alias("other"), F.col("node").alias("q"), F.col("n").alias("qn"))
    pairs = two.join(a, ["key", "comp"]).join(b, ["key", "other"]).where(F.least("pn", "qn") >= similarity * F.greatest("pn", "qn") - 1e-9)
    fresh = pairs.select(F.greatest("p", "q").alias("src"), F.least("p", "q").alias("dst")).distinct().join(stars, ["src", "dst"], "left_anti")
    second = similar_pairs(cut(fresh, "near-pairs"), sets, similarity)
    many = left.join(count.where(F.col("size") > FEW).select("key", "main"), "key")
    return connected_components(first.union(second).union(cut(block_links(many, sets, similarity), "near-block-links")), "near-components")


def keep_one(docs: DataFrame, text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of ``docs``: that with the smallest id, among rows that repeat it the one whose row hash is least.

    A group is what links of exact Jaccard similarity of at least ``similarity``
    over shingles of ``shingle`` words join. Groups are held by their texts,
    never by their ids, so rows with null or repeated ids and different texts
    stay apart. A row with a null ``doc_id`` stands only if its group has no
    other id.
    """
    return one_of_each(docs, text_node(text), similar_links(docs, text, shingle, similarity))


def one_of_each(docs: DataFrame, node: Column, roots: DataFrame) -> DataFrame:
    """The least row of each component by (id, nulls last; row hash).

    ``roots`` has (node, component); a node it does not name is its own
    component. The least is found on ids and hashes alone, so a large group is
    pre-aggregated before it moves, and whole rows are joined to it afterwards.
    """
    keys = ["n", "missing", "id", "h"]
    doc = F.col("doc_id")
    rows = docs.select(whole_row(docs).alias("whole"), doc.alias("doc"), node.alias("n"), doc.isNull().alias("missing"), F.coalesce(F.xxhash64(doc), F.lit(0)).alias("id"), row_hash(docs).alias("h"))
    labelled = rows.select(*keys, "doc").join(roots.select(F.col("node").alias("n"), "component"), "n", "left").withColumn("root", F.coalesce("component", "n")).withColumn("alone", F.col("component").isNull())
    least = labelled.groupBy("alone", "root").agg(F.min(F.struct("missing", "doc", "h", "n", "id")).alias("m")).select(*[F.col(f"m.{k}").alias(k) for k in keys])
    return rows.join(least, keys, "left_semi").groupBy(*keys).agg(F.first("whole").alias("whole")).select("whole.*")
