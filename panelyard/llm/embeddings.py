"""Embedding near-duplicates by PCA-ordered, tiled comparison with suffix-norm bounds."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import connected_components, cut, scratch_path, ship

#: Leading coordinates on which blocks are boxed.
BOX = 8
#: Rows of a tile.
TILE = 1024
#: Cosines this near the threshold are summed again by one routine.
NEAR = 1e-12


def usable(column: str) -> Column:
    """A vector that has a direction: not null or empty, no null or non-finite component, not all zero."""
    c, bad = F.col(column), F.lit(float("inf"))
    return c.isNotNull() & (F.size(c) > 0) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == bad)) & F.exists(c, lambda x: x != 0)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Unit rows in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Frame:
    """A rotation to principal axes and a kd-tree on the leading ones.

    Both come from a bounded sample. Any rotation keeps cosines and any leaves
    cover all vectors, so they decide how fast the comparison is and never its
    result.
    """

    def __init__(self, sample: np.ndarray, leaves: int):
        width = sample.shape[1]
        values, axes = np.linalg.eigh(sample.T @ sample / max(1, len(sample)))
        self.axes = axes[:, np.argsort(-values, kind="stable")]
        self.width, self.nodes = width, []
        self._split(sample @ self.axes, 0, max(0, (leaves - 1).bit_length()))

    def _split(self, z: np.ndarray, depth: int, most: int) -> None:
        """Median splits, each on the widest of the leading axes; nodes in heap order."""
        self.depth, level = 0, [z]
        for _ in range(most):
            if min(len(x) for x in level) < 8:
                break
            below = []
            for x in level:
                lead = x[:, : min(BOX, self.width)]
                k = int(np.argmax(lead.max(axis=0) - lead.min(axis=0)))
                cut_at = float(np.median(lead[:, k]))
                self.nodes.append((k, cut_at))
                below += [x[x[:, k] < cut_at], x[x[:, k] >= cut_at]]
            level, self.depth = below, self.depth + 1

    def rotate(self, x: np.ndarray) -> np.ndarray:
        return x @ self.axes

    def leaf(self, z: np.ndarray) -> np.ndarray:
        at = np.zeros(len(z), dtype=np.int64)
        axis, value = np.array([n[0] for n in self.nodes], dtype=np.int64), np.array([n[1] for n in self.nodes])
        for _ in range(self.depth):
            at = 2 * at + 1 + (z[np.arange(len(z)), axis[at]] >= value[at])
        return at - (2**self.depth - 1)


class Forest:
    """Union-find over a block pair; ``edges`` are the links that joined two trees."""

    def __init__(self, n: int):
        self.up, self.edges = list(range(n)), []

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        p, q = self.find(a), self.find(b)
        if p != q:
            self.up[max(p, q)] = min(p, q)
            self.edges.append((a, b))

    def labels(self, lo: int, hi: int) -> np.ndarray:
        return np.array([self.find(k) for k in range(lo, hi)], dtype=np.int64)


def cosines(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows, always summed in the same order: decides pairs at the threshold."""
    return np.einsum("ij,ij->i", x[i], y[j])


def compare(x: np.ndarray, y: np.ndarray, wx: np.ndarray, wy: np.ndarray, threshold: float, same: bool):
    """Links between unit rows of ``x`` and ``y`` (in principal axes) with cosine >= ``threshold``.

    Returns the weights linked to each row of x, those linked to each row of y,
    and a spanning forest of the links (positions in x, then in y). Where
    ``same``, x is y and each pair counts once for each of its sides. Tile by
    tile, the leading coordinates' products come first; with the norms of what
    is left they bound the cosine, and pairs that cannot reach the threshold
    stop there. Survivors go on by further coordinates to the whole product;
    where most of a tile survives, its whole product is taken at once.
    """
    width = x.shape[1]
    cuts = sorted({min(width, max(1, width * k // 8)) for k in (2, 4, 6, 8)})
    tails = [(np.sqrt(np.maximum(0, np.einsum("ij,ij->i", x[:, c:], x[:, c:]))), np.sqrt(np.maximum(0, np.einsum("ij,ij->i", y[:, c:], y[:, c:])))) for c in cuts]
    lead = cuts[0]
    x32, y32 = np.ascontiguousarray(x[:, :lead], dtype=np.float32), np.ascontiguousarray(y[:, :lead].T, dtype=np.float32)
    tx, ty = tails[0][0].astype(np.float32), tails[0][1].astype(np.float32)
    nx, forest = len(x), Forest(len(x) if same else len(x) + len(y))
    shift = 0 if same else nx
    cx, cy = np.zeros(nx, dtype=np.int64), np.zeros(len(y), dtype=np.int64)
    for a in range(0, nx, TILE):
        ax = slice(a, min(a + TILE, nx))
        for b in range(a if same else 0, len(y), TILE):
            by = slice(b, min(b + TILE, len(y)))
            bound = x32[ax] @ y32[:, by]
            bound += tx[ax, None] * ty[None, by]
            alive = bound >= np.float32(threshold - 1e-4)
            if same and a == b:
                alive = np.triu(alive, 1)
            n = int(np.count_nonzero(alive))
            if not n:
                continue
            if n > alive.size // 32:
                dense = x[ax] @ y[by].T
                hit = alive & (dense >= threshold)
                i, j = np.nonzero(alive & (np.abs(dense - threshold) < NEAR))
                hit[i, j] = cosines(x, y, i + a, j + b) >= threshold
                if not hit.any():
                    continue
                cx[ax] += hit @ wy[by]
                cy[by] += wx[ax] @ hit
                while True:  # each round joins every tree that still has a link to another
                    rest = hit & (forest.labels(ax.start, ax.stop)[:, None] != forest.labels(shift + by.start, shift + by.stop)[None, :])
                    rows, cols = np.flatnonzero(rest.any(axis=1)), np.flatnonzero(rest.any(axis=0))
                    if not len(rows):
                        break
                    for i, j in [*zip(rows, rest[rows].argmax(axis=1), strict=True), *zip(rest[:, cols].argmax(axis=0), cols, strict=True)]:
                        forest.join(a + int(i), shift + b + int(j))
                continue
            i, j = np.nonzero(alive)
            i, j = i + a, j + b
            dot, done = np.zeros(len(i)), 0
            for c, (sx, sy) in zip(cuts, tails, strict=True):
                dot = dot + np.einsum("ij,ij->i", x[i, done:c], y[j, done:c])
                if c == width:
                    close = np.abs(dot - threshold) < NEAR
                    dot[close] = cosines(x, y, i[close], j[close])
                stay = dot + (sx[i] * sy[j] if c < width else 0.0) >= threshold - (1e-9 if c < width else 0.0)
                i, j, dot, done = i[stay], j[stay], dot[stay], c
            np.add.at(cx, i, wy[j])
            np.add.at(cy, j, wx[i])
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                forest.join(p, shift + q)
    return cx, cy, forest.edges


def near_duplicates(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = 0.95, block: int = 8192, sample: int = 8192) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row.

    All vectors of one length are compared with each other by cosine; vectors
    of other lengths, and those that are null, empty, zero or hold a null or
    non-finite component, link with nothing. Equal vectors are compared once
    and counted as often as they occur. Rows may share an id or have none: they
    link by their vectors, and ``component_id`` is the smallest id of the
    component that is not null (null if there is none). Other columns are
    ignored, and an empty table gives an empty result.

    Distinct vectors are dealt to blocks: leaves of a kd-tree on the leading
    principal axes, large leaves cut by a hash. Every block is written once to
    the shared folder. Two blocks meet in one task, which reads them there,
    unless the boxes of their leaves are too far apart for the threshold; only
    the numbers of block pairs are shuffled. A task returns sums of links and a
    spanning forest, never its pairs. The sample and the leaves' counts and
    boxes are all that reaches the driver.
    """
    element = vectors.schema[column].dataType.elementType.simpleString()
    clean = F.transform(F.col(column), lambda v: F.when(v == 0, F.lit(0).cast(element)).otherwise(v))
    rows = vectors.select(F.col(key).alias("vec_id"), F.when(usable(column), clean).alias("v"))
    rows = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.hash("v"))
    good = rows.where("v IS NOT NULL")
    distinct = good.groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("h1").alias("h1"), F.first("h2").alias("h2"))
    # A vector is a node by its hashes, so ids may be null or repeat.
    distinct = cut(distinct.withColumn("rep", F.concat_ws(":", "h1", "h2")), "embeddings")
    widths = [r[0] for r in distinct.select(F.size("v").alias("d")).distinct().collect()]
    parts = [p for d in sorted(widths) if (p := _linked(distinct.where(F.size("v") == d), d, threshold, block, sample)) is not None]
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(reduce(DataFrame.union, parts), "embedding-links")
    counts = found.where("other IS NULL").groupBy("h1", "h2").agg(F.sum("n").alias("more"))
    comps = connected_components(found.where("other IS NOT NULL").select(F.col("rep").alias("src"), F.col("other").alias("dst")), "embedding-components")
    members = comps.join(distinct.select(F.col("rep").alias("node"), "least"), "node")
    members = members.join(members.groupBy("component").agg(F.min("least").alias("first")), "component").select(F.col("node").alias("rep"), "first")
    every = distinct.select("rep", "least", "n", "h1", "h2").join(counts, ["h1", "h2"], "left").join(members, "rep", "left")
    every = every.select("h1", "h2", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("first", "least").alias("component_id"))
    lone = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = good.select("vec_id", "h1", "h2").join(every, ["h1", "h2"]).select("vec_id", "n_links", "component_id").union(lone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _linked(distinct: DataFrame, width: int, threshold: float, block: int, sample: int) -> DataFrame | None:
    """Sums of linked weights (``other`` null) and forest edges (``rep``, ``other``) of vectors of one length."""
    n = distinct.count()
    if n < 2:
        return None
    share = min(1.0, sample / n)
    some = distinct.where(F.pmod("h1", F.lit(2**31)) < int(share * 2**31) + 1).select("v").limit(2 * sample).toArrow()
    frame = Frame(matrix(some.column("v"), width), -(-n // block)) if some.num_rows else Frame(np.eye(width), 1)
    lead, name = min(BOX, width), "string"

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                z = frame.rotate(matrix(batch.column(4), width))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(frame.leaf(z)), pa.array(z[:, :lead].tolist(), pa.list_(pa.float64()))], names=["rep", "n", "h1", "h2", "v", "leaf", "lead"])

    element = distinct.schema["v"].dataType.simpleString()
    placed = cut(distinct.select("rep", "n", "h1", "h2", "v").mapInArrow(place, f"rep {name}, n long, h1 long, h2 int, v {element}, leaf long, lead array<double>"), "embedding-places")
    boxes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *[F.min(F.get("lead", F.lit(k))).alias(f"lo{k}") for k in range(lead)], *[F.max(F.get("lead", F.lit(k))).alias(f"hi{k}") for k in range(lead)]).orderBy("leaf").collect()
    cuts_of = np.array([-(-r["n"] // block) for r in boxes])
    first, order = np.cumsum([0, *cuts_of]), {r["leaf"]: i for i, r in enumerate(boxes)}
    low, high = (np.repeat(np.array([[r[f"{side}{k}"] for k in range(lead)] for r in boxes]), cuts_of, axis=0) for side in ("lo", "hi"))
    reach, total = 2 - 2 * threshold + 1e-9, int(first[-1])
    spark = distinct.sparkSession
    held = ship(spark, (low, high))  # 16 numbers a block
    path = _write_blocks(placed, name, element, first, order)

    def meets(batches):
        lo, hi = held()
        for batch in batches:
            for i in batch.column(0).to_pylist():
                gap = np.maximum(0, np.maximum(lo[i] - hi[i:], lo[i:] - hi[i]))
                j = i + np.flatnonzero((gap * gap).sum(axis=1) <= reach)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), i)), pa.array(j)], names=["i", "j"])

    width_of = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total)
    pairs = spark.range(total).repartition(min(total, width_of)).mapInArrow(meets, "i long, j long").repartition(width_of, "i", "j").sortWithinPartitions("i", "j")

    def meet(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        read: dict[int, tuple] = {}

        def load(b):
            if b not in read:
                table = pads.dataset(f"{root}/block={b}", filesystem=fs, format="parquet").to_table(columns=["rep", "n", "h1", "h2", "v"]).combine_chunks()
                order = np.lexsort((table.column("h2").to_numpy(), table.column("h1").to_numpy()))
                table = table.take(pa.array(order)).combine_chunks()
                read[b] = (table, table.column("n").to_numpy(), frame.rotate(matrix(table.column("v"), width)))
            return read[b]

        for batch in batches:
            for i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for b in [b for b in read if b not in (i, j)]:
                    del read[b]  # at most two blocks at a time
                (ta, wa, za), (tb, wb, zb) = load(i), load(j)
                cx, cy, edges = compare(za, zb, wa, wb, threshold, i == j)
                both = ta if i == j else pa.concat_tables([ta, tb])
                sums = cx + cy if i == j else np.concatenate([cx, cy])
                pos = pa.array(np.flatnonzero(sums), pa.int64())
                src, dst = (pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1))
                col = lambda c: both.column(c).combine_chunks()  # noqa: B023, E731
                reps, h1, h2, none = col("rep"), col("h1"), col("h2"), len(src)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([reps.take(pos), reps.take(src)]),
                        pa.concat_arrays([pa.nulls(len(pos), reps.type), reps.take(dst)]),
                        pa.concat_arrays([h1.take(pos), pa.nulls(none, h1.type)]),
                        pa.concat_arrays([h2.take(pos), pa.nulls(none, h2.type)]),
                        pa.concat_arrays([pa.array(sums[sums > 0], pa.int64()), pa.nulls(none, pa.int64())]),
                    ],
                    names=["rep", "other", "h1", "h2", "n"],
                )

    return pairs.mapInArrow(meet, f"rep {name}, other {name}, h1 long, h2 int, n long")


def _write_blocks(placed: DataFrame, name: str, element: str, first: np.ndarray, order: dict[int, int]) -> str:
    """Writes every block once to the shared folder, a folder each, and returns where; large leaves are cut by a hash."""

    def own(batches):
        for batch in batches:
            leaf = np.array([order[x] for x in batch.column(5).to_pylist()], dtype=np.int64)
            sizes = (first[leaf + 1] - first[leaf]).astype(np.uint64)
            at = first[leaf] + (batch.column(2).to_numpy().view(np.uint64) % np.maximum(sizes, np.uint64(1))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(at, pa.int64())], names=["rep", "n", "h1", "h2", "v", "block"])

    path = scratch_path(placed.sparkSession, "embedding-blocks")
    dealt = placed.select("rep", "n", "h1", "h2", "v", "leaf").mapInArrow(own, f"rep {name}, n long, h1 long, h2 int, v {element}, block long")
    width = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(first[-1]))
    dealt.repartition(width, "block").write.option("compression", "zstd").partitionBy("block").parquet(path)
    return path


#: ``near_duplicates`` in DuckDB, for small tables.
NEAR_SQL = """
WITH RECURSIVE ok AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
