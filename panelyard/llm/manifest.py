"""A dataset's manifest: a persistent Merkle tree over all rows, and versions of it that copy one path each."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.common import cut, id_crc32

#: Children of a node, levels of an aligned block, and leaves of one.
FAN, LEVELS = 8, 4
SPAN = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for a null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """SHA-256 over the fields of a row, in 32 bytes; ``changed`` takes the place of columns of that name."""
    return F.unhex(F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256))


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered(every: int = 3) -> Column:
    """Rows whose id's unsigned CRC-32 is divisible by ``every``; never those without an id."""
    return F.coalesce(id_crc32() % every == 0, F.lit(False))


def digest(children: list[bytes]) -> bytes:
    """SHA-256 over the hex text of digests, joined."""
    return hashlib.sha256(b"".join(c.hex().encode() for c in children)).digest()


class Tree:
    """An aligned block of a tree: the nodes of every level, from the leaves to ``levels`` above them."""

    def __init__(self, leaves: list[bytes], levels: int):
        self.nodes = [leaves]
        for _ in range(levels):
            below = self.nodes[-1]
            self.nodes.append([digest(below[at : at + FAN]) for at in range(0, len(below), FAN)])

    @property
    def root(self) -> bytes:
        return self.nodes[-1][0]

    def siblings(self, at: int) -> list[tuple[list[bytes], list[bytes]]]:
        """For each level, the others of the node's run: those left and those right of it."""
        out = []
        for level in self.nodes[:-1]:
            lo = at - at % FAN
            out.append((level[lo:at], level[at + 1 : lo + FAN]))
            at //= FAN
        return out

    def version(self, at: int, new: bytes) -> list[bytes]:
        """The nodes that a version with another leaf at ``at`` copies, leaf to root; it shares all others with this tree."""
        return continued(new, self.siblings(at))


def continued(node: bytes, path: list[tuple[list[bytes], list[bytes]]]) -> list[bytes]:
    """The node and those that a version with it has above, over the levels of a path to the root."""
    out = [node]
    for left, right in path:
        out.append(digest([*left, out[-1], *right]))
    return out


PATH = "array<struct<left: array<binary>, right: array<binary>>>"
_PATH = pa.list_(pa.struct([("left", pa.list_(pa.binary())), ("right", pa.list_(pa.binary()))]))


def ranked(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``pos``, the place from 0 in the order of ``order`` within ``tree``, and ``total``, its tree's rows.

    Rows are dealt to ranges of like row count by all of the order and a number
    of the row, so neither a common tree nor a common id is one range; a range
    counts its rows tree by tree as they pass, and a window over the ranges'
    counts (a row for each range and tree) gives what stands before.
    """
    held = cut(nodes, f"{name}-rows").withColumn("u", F.monotonically_increasing_id())
    parts = max(1, min(32_768, held.count() // SPAN))
    dealt = held.repartitionByRange(parts, "tree", *order, "u").sortWithinPartitions("tree", *order, "u").withColumn("part", F.spark_partition_id())
    columns = [*nodes.columns, "part"]

    def count(batches):
        tree, at = None, 0
        for batch in batches:
            pos = []
            for t in batch.column(0).to_pylist():
                tree, at = (t, at + 1) if t == tree else (t, 0)
                pos.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pos, pa.int64())], names=[*columns, "local"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    local = cut(dealt.select("tree", *[c for c in columns if c != "tree"]).mapInArrow(count, f"{fields}, part int, local long"), f"{name}-ranges")
    sizes = local.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("before", before).withColumn("total", F.sum("n").over(whole)).drop("n")
    return local.join(sizes, ["tree", "part"]).withColumn("pos", F.col("local") + F.col("before")).drop("part", "local", "before")


def height(total: Column, most: int = LEVELS) -> Column:
    """Levels that a tree of so many nodes has in a block: at most ``most``."""
    return sum(((total > FAN**k).cast("int") for k in range(1, most)), (total > 1).cast("int"))


def _block_roots(nodes: DataFrame) -> DataFrame:
    """The root of every aligned block of ``nodes`` (tree, pos, total, node), as nodes of the tree above them."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        tree = Tree(table.column("node").to_pylist(), table.column("levels")[0].as_py())
        return pa.table({"tree": table.column("tree")[:1], "pos": table.column("block")[:1], "total": pa.array([-(-table.column("total")[0].as_py() // SPAN)], pa.int64()), "node": pa.array([tree.root], pa.binary())})

    return blocked(nodes).groupBy("tree", "block").applyInArrow(build, "tree string, pos long, total long, node binary")


def blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / SPAN).cast("long")).withColumn("levels", height(F.col("total")))


def _paths(nodes: DataFrame) -> DataFrame:
    """``tree``, ``pos``, ``block``, and of every node of ``nodes`` the ``path`` of siblings up to its block's root."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        tree = Tree(table.column("node").to_pylist(), table.column("levels")[0].as_py())
        rows = [[{"left": a, "right": b} for a, b in tree.siblings(k)] for k in range(table.num_rows)]
        return pa.table({"tree": table.column("tree"), "pos": table.column("pos"), "block": table.column("block"), "path": pa.array(rows, _PATH)})

    return blocked(nodes).groupBy("tree", "block").applyInArrow(build, f"tree string, pos long, block long, path {PATH}")


def upper_paths(nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Of each of ``nodes`` (tree, pos, total, node) the path to its tree's root, as (tree, pos, path); and each tree's root, as (tree, node).

    Nodes are joined in aligned blocks of SPAN, their roots likewise, until
    every tree is one node: one round for each factor of SPAN. Then the rounds'
    paths are put together from the top down.
    """
    rounds, now = [], nodes
    while True:
        if now.agg(F.max("total")).first()[0] == 1:
            break
        rounds.append(cut(_paths(now), f"{name}-paths"))
        now = cut(_block_roots(now), f"{name}-nodes")
    roots = now.select("tree", "node")
    if not rounds:
        return now.select("tree", "pos", F.from_json(F.lit("[]"), PATH).alias("path")), roots
    path = rounds[-1].select("tree", "pos", "path")
    for below in rounds[-2::-1]:
        above = path.select("tree", F.col("pos").alias("block"), F.col("path").alias("above"))
        path = cut(below.join(above, ["tree", "block"]).select("tree", "pos", F.concat("path", "above").alias("path")), f"{name}-joined")
    return path, roots


def _stood(docs: DataFrame, where: Column) -> tuple[DataFrame, DataFrame, bytes, str] | None:
    """Leaves in their places (with ``new`` where changed), the way from each block's root to the top, the root and the ids' type; None without a row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    leaves = docs.select(tree.alias("tree"), "doc_id", leaf().alias("node"), F.when(where & (F.col("text") != lowered(F.col("text"))), leaf(text=lowered(F.col("text")))).alias("new"))
    placed = cut(ranked(leaves, ["doc_id", "node"], "manifest"), "manifest-leaves")
    tops = cut(_block_roots(placed.select("tree", "pos", "total", "node")), "manifest-blocks")
    if tops.isEmpty():
        return None
    path, subroots = upper_paths(tops, "manifest-upper")
    langs = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "node"), ["lang"], "manifest-langs")
    top_path, roots = upper_paths(cut(langs.select("tree", "pos", "total", "node"), "manifest-subroots"), "manifest-top")
    of_lang = langs.join(top_path.withColumnRenamed("path", "above"), ["tree", "pos"]).select(F.col("lang").alias("tree"), F.col("node").alias("subroot"), F.col("pos").alias("place"), "above")
    ways = path.join(of_lang, "tree").select("tree", F.col("pos").alias("block"), "subroot", "place", F.size("path").alias("inside"), F.concat("path", "above").alias("path"))
    return blocked(placed), cut(ways, "manifest-ways"), roots.first()["node"], kind


def _way(table: pa.Table) -> list[tuple[list[bytes], list[bytes]]]:
    return [(x["left"], x["right"]) for x in table.column("path")[0].as_py()]


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified`` for every row.

    A row is a leaf: the hash of its doc_id, source, lang, n_chars and text. The
    leaves of a lang stand in order of doc_id, runs of FAN nodes become one until
    one is left, the lang's subroot; the subroots in order of lang (null first,
    bytewise) give the root likewise. ``proof_sha256`` is over all siblings from
    the leaf to the root. Where ``changed`` holds (``tampered()`` if none is
    given), a version with the text in lower case is made: it copies the leaf's
    ancestors and shares all other nodes; ``folded_root`` is its root (elsewhere
    the root recomputed from the leaf itself) and ``verified`` whether that is
    the manifest's.

    Texts are hashed where they are read; only digests are shuffled. Aligned
    blocks of SPAN leaves are built and versioned inside tasks, each with the
    one way that its root has to the top, so a common lang is many tasks and no
    task holds more than a block. Langs may be many: they are ranked and joined
    like leaves.

    A null doc_id stands first and is never tampered with; rows of one id stand
    in order of their hashes, and equal rows are leaves each. Other columns are
    ignored; an empty table gives an empty result.
    """
    stood = _stood(docs, tampered() if changed is None else changed)
    schema = "doc_id {}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if stood is None:
        return docs.sparkSession.createDataFrame([], schema.format(docs.schema["doc_id"].dataType.simpleString()))
    leaves, ways, root, kind = stood

    def versions(rows: pa.Table, way: pa.Table) -> pa.Table:
        rows, upper = rows.sort_by("pos"), _way(way)
        tree = Tree(rows.column("node").to_pylist(), rows.column("levels")[0].as_py())
        text = lambda path: "".join(d.hex() for left, right in path for d in (*left, *right)).encode()
        rest, proofs, folded = text(upper), [], []
        for at, (own, new) in enumerate(zip(tree.nodes[0], rows.column("new").to_pylist(), strict=True)):
            proofs.append(hashlib.sha256(text(tree.siblings(at)) + rest).hexdigest())
            folded.append(continued(tree.version(at, own if new is None else new)[-1], upper)[-1])
        n = rows.num_rows
        out = {"doc_id": rows.column("doc_id"), "leaf": [d.hex() for d in tree.nodes[0]], "subroot": [way.column("subroot")[0].as_py().hex()] * n, "root": [root.hex()] * n}
        return pa.table(out | {"proof_sha256": proofs, "folded_root": [d.hex() for d in folded], "verified": [d == root for d in folded]})

    return leaves.groupBy("tree", "block").cogroup(ways.groupBy("tree", "block")).applyInArrow(versions, schema.format(kind))


def copied_nodes(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """What the versions of ``manifest`` store beyond the tree itself: ``doc_id``, ``lang``, ``level``, ``pos``, ``node``.

    A row for each copied node of each tampered row, from its leaf (level 0 of
    its lang's tree) up to the root. Levels go on through the tree of the
    subroots, whose nodes have no lang of their own: ``top`` is true there, and
    ``pos`` counts from 0 within the level. A version is these nodes and all the
    tree's others.
    """
    stood = _stood(docs, tampered() if changed is None else changed)
    schema = "doc_id {}, lang string, top boolean, level int, pos long, node string"
    if stood is None:
        return docs.sparkSession.createDataFrame([], schema.format(docs.schema["doc_id"].dataType.simpleString()))
    leaves, ways, _, kind = stood

    def versions(rows: pa.Table, way: pa.Table) -> pa.Table:
        rows, upper = rows.sort_by("pos"), _way(way)
        levels = rows.column("levels")[0].as_py()
        tree, inside = Tree(rows.column("node").to_pylist(), levels), levels + way.column("inside")[0].as_py()
        name, place, out = rows.column("tree")[0].as_py(), way.column("place")[0].as_py(), []
        for at, (doc, pos, new) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "pos", "new")), strict=True)):
            if new is not None:
                copied = tree.version(at, new)
                copied += continued(copied[-1], upper)[1:]
                for level, node in enumerate(copied):
                    at_level = pos // FAN**level if level <= inside else place // FAN ** (level - inside)
                    out.append((doc, name[1:] if name else None, level > inside, level, at_level, node.hex()))
        return pa.table({c: pa.array([x[k] for x in out], t) for k, (c, t) in enumerate([("doc_id", rows.schema.field("doc_id").type), ("lang", pa.string()), ("top", pa.bool_()), ("level", pa.int32()), ("pos", pa.int64()), ("node", pa.string())])})

    return leaves.groupBy("tree", "block").cogroup(ways.groupBy("tree", "block")).applyInArrow(versions, schema.format(kind))


#: ``manifest`` in DuckDB, for small tables of unique ids. CRC-32 is made from its byte table.
MANIFEST_SQL = """
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i, list_resize([0::BIGINT], 8, 0::BIGINT)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256))::BIGINT AS i)),
d AS (SELECT doc_id, coalesce('=' || lang, '') AS l, text, concat(f(doc_id::VARCHAR), f(source), f(lang), f(n_chars::VARCHAR)) AS head,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda x, b: xor(x >> 8, t[xor(x & 255, b) + 1])), 4294967295::BIGINT) % 3 = 0 AS tampered
  FROM documents, crc),
h AS (SELECT *, sha256(head || f(text)) AS leaf, sha256(head || f(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS low, row_number() OVER (PARTITION BY l ORDER BY doc_id) - 1 AS i FROM d),
n AS (SELECT l, 0 AS k, i, leaf AS x, count(*) OVER (PARTITION BY l) AS m FROM h
  UNION ALL SELECT l, k + 1, i // 8, sha256(string_agg(x, '' ORDER BY i)), (any_value(m) + 7) // 8 FROM n WHERE m > 1 GROUP BY l, k, i // 8),
u AS (SELECT l, k, x, row_number() OVER (ORDER BY l) - 1 AS j FROM n WHERE m = 1),
w AS (SELECT 0 AS k, j AS i, x, count(*) OVER () AS m FROM u
  UNION ALL SELECT k + 1, i // 8, sha256(string_agg(x, '' ORDER BY i)), (any_value(m) + 7) // 8 FROM w WHERE m > 1 GROUP BY k, i // 8),
a AS (SELECT l, k, i, x FROM n WHERE m > 1 UNION ALL SELECT u.l, u.k + w.k, w.i, w.x FROM u, w WHERE w.m > 1),
p AS (SELECT doc_id, l, 0 AS k, i, CASE WHEN tampered AND text IS NOT NULL THEN low ELSE leaf END AS x FROM h
  UNION ALL SELECT p.doc_id, p.l, p.k + 1, p.s // 8, sha256(string_agg(CASE WHEN a.i = p.s THEN p.x ELSE a.x END, '' ORDER BY a.i))
  FROM (SELECT p.doc_id, p.l, p.k, p.x, CASE WHEN p.k = u.k THEN u.j ELSE p.i END AS s FROM p JOIN u USING (l)) p JOIN a ON a.l = p.l AND a.k = p.k AND a.i // 8 = p.s // 8 GROUP BY p.doc_id, p.l, p.k, p.s),
b AS (SELECT p.doc_id, sha256(coalesce(string_agg(a.x, '' ORDER BY a.k, a.i), '')) AS proof
  FROM (SELECT p.doc_id, p.l, p.k, CASE WHEN p.k = u.k THEN u.j ELSE p.i END AS s FROM p JOIN u USING (l)) p LEFT JOIN a ON a.l = p.l AND a.k = p.k AND a.i // 8 = p.s // 8 AND a.i <> p.s GROUP BY p.doc_id),
r AS (SELECT x AS root FROM w WHERE m = 1),
o AS (SELECT doc_id, arg_max(x, k) AS folded FROM p GROUP BY doc_id)
SELECT h.doc_id, h.leaf, u.x AS subroot, r.root, b.proof AS proof_sha256, o.folded AS folded_root, o.folded = r.root AS verified
FROM h JOIN u USING (l) JOIN b USING (doc_id) JOIN o USING (doc_id), r
"""
for _column in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"):
    MANIFEST_SQL = MANIFEST_SQL.replace(f"f({_column})", f"coalesce(strlen({_column}) || ':' || {_column}, '-')")
