"""Hard negatives for contrastive training: slot-decomposed selection over all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.llm.common import cut, scratch_path

#: Components of this size or more have no part: products of such could leave the range of a long.
LARGEST = 2**20
#: Anchors of a tile.
TILE = 256
#: What stands below every score.
NONE = np.iinfo(np.int64).min


def relabelled(rows: DataFrame) -> DataFrame:
    """Labels as the query has them: where vec_id is divisible by 7, (label + 1) modulo 10."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def usable(column: str) -> Column:
    """A vector without a null, non-finite or too large component."""
    c = F.col(column)
    return c.isNotNull() & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST))


def largest(score: np.ndarray, allowed: np.ndarray, k: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the ``k`` largest allowed scores and their columns, ties by the smaller column: (places of the row, k) with NONE where there are fewer.

    ``most`` bounds the size of any score. Where it leaves room for the column,
    both go in one long, so that a partition (no sort) finds exactly ``k``.
    """
    n = score.shape[1]
    k = min(k, n)
    bits = max(1, (n - 1).bit_length())
    if most < 1 << (62 - bits):
        key = np.where(allowed, (score << bits) + (n - 1 - np.arange(n)), NONE)
        at = np.argpartition(key, n - k, axis=1)[:, n - k :]
    else:
        at = np.argsort(np.where(allowed, -score, -(NONE + 1)), axis=1, kind="stable")[:, :k]
    return np.where(np.take_along_axis(allowed, at, 1), np.take_along_axis(score, at, 1), NONE), at


def products(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """Integer inner products of rows and a bound of their size; by floating point where that is exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64), most
    return a @ b.T, most


class Best:
    """The best ``k`` (score, id) of each key so far."""

    def __init__(self, k: int):
        self.k, self.key, self.score, self.id = k, *(np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        key, score, ids = np.concatenate([self.key, key]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
        keep = rank < self.k
        self.key, self.score, self.id = key[keep], score[keep], ids[keep]


def _blocks(rows: DataFrame, count: int, name: str, key: str) -> str:
    """Writes ``rows`` once to the shared folder in ``count`` blocks by a hash of the column ``key``, a folder each, and returns where."""
    path = scratch_path(rows.sparkSession, name)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(key, F.lit(11)), F.lit(count)))
    width = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), count)
    dealt.repartition(width, "block").write.option("compression", "zstd").partitionBy("block").parquet(path)
    return path


def _read(path: str, block: int, columns: list[str]) -> dict[int, tuple[pa.Table, np.ndarray]]:
    """A block by the length of its vectors: its rows by id, and floor(256 x) of their components; empty where nothing was dealt to it."""
    fs, root = pafs.FileSystem.from_uri(path)
    at = f"{root}/block={block}"
    if fs.get_file_info(at).type == pafs.FileType.NotFound:
        return {}
    table = pads.dataset(at, filesystem=fs, format="parquet").to_table(columns=[*columns, "v"]).combine_chunks()
    table = table.take(pa.array(np.argsort(table.column("vec_id").to_numpy(), kind="stable")))
    lengths, out = table.column("v").combine_chunks().value_lengths().to_numpy(), {}
    for width in np.unique(lengths):
        own = table.take(pa.array(np.flatnonzero(lengths == width))).combine_chunks()
        flat = own.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out[int(width)] = (own.drop_columns(["v"]), np.floor(256 * flat).astype(np.int64).reshape(own.num_rows, int(width)))
    return out


def _meetings(spark: SparkSession, anchor_path: str, row_path: str, shape: tuple[int, int], slots: int, k: int) -> DataFrame:
    """The best ``k`` rows of every (anchor, slot), as ``anchor``, ``slot``, ``vec_id``, ``score``.

    With 0 slots: the rows of the anchor's label, all in slot 0. Else those of
    other labels, each in the slot of the least of the anchor's ``limits`` that
    it does not exceed. A task holds one block of anchors and streams some blocks
    of rows past it, one at a time; it returns at most k rows a slot, whatever it
    has read.
    """
    n_anchor, n_row = shape
    want = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = max(1, min(n_row, -(-want // n_anchor)))
    width_of = max(1, slots)

    def meet(batches):
        for batch in batches:
            for at in batch.column(0).to_pylist():
                yield from one(at % n_anchor, at // n_anchor)

    def one(a, r):
        held = _read(anchor_path, a, ["anchor", "vec_id", "label", *(["limits"] if slots else [])])
        best = {w: Best(k) for w in held}
        for b in range(r, n_row, runs):
            rows = _read(row_path, b, ["vec_id", "label"])
            for width in held.keys() & rows.keys():
                (ta, xa), (tb, xb) = held[width], rows[width]
                ids, labels, ida, laba = (t.column(c).to_numpy() for t in (tb, ta) for c in ("vec_id", "label"))
                tops = np.array([x + [NONE] * (slots - len(x)) for x in ta.column("limits").to_pylist()], dtype=np.int64).reshape(-1, slots) if slots else None
                for at in range(0, len(ida), TILE):
                    t = slice(at, at + TILE)
                    score, most = products(xa[t], xb)
                    same = labels[None, :] == laba[t, None]
                    for s in range(width_of):
                        if not slots:
                            fits = same & (ids[None, :] != ida[t, None])
                        else:
                            fits = ~same & (score <= tops[t, s, None])
                            if s + 1 < slots:
                                fits &= score > tops[t, s + 1, None]
                        if not fits.any():
                            continue
                        top, col = largest(score, fits, k, most)
                        i, j = np.nonzero(top > NONE)
                        best[width].add((i + at) * width_of + s, top[i, j], ids[col[i, j]])
        for width, found in best.items():
            if len(found.key):
                names = held[width][0].column("anchor").combine_chunks()
                yield pa.RecordBatch.from_arrays([names.take(pa.array(found.key // width_of)), pa.array(found.key % width_of, pa.int64()), pa.array(found.id), pa.array(found.score)], names=["anchor", "slot", "vec_id", "score"])

    tasks = n_anchor * runs
    return spark.range(0, tasks, 1, min(tasks, 100_000)).mapInArrow(meet, "anchor string, slot long, vec_id long, score long")


def _first(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The best ``k`` rows of every key, with their rank; Spark keeps no more than that of each task before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = 8192, anchor_block: int = 1024) -> DataFrame:
    """Hard negatives of every anchor and positive: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``vectors`` has ``vec_id``, ``embedding`` and ``label``. Anchors are the rows
    whose id is divisible by ``every``; a score is the integer inner product of
    floor(256 x) of the components. Positives of an anchor are its first
    ``positives`` rows of its label by (score descending, id); negatives of a
    positive its first ``negatives`` rows of other labels with
    low x positive_score <= 100 x score <= high x positive_score.

    The positives' upper limits cut the scores into disjoint slots. Every task
    keeps the best ``negatives`` of each slot, tasks' results are merged slot by
    slot, and the slots from a positive's own downwards, joined, begin with its
    window's answer: only its lower limit is still to be applied. All rows meet
    all anchors, block by block; both are written once and only block numbers
    are dealt. Tasks hold one block of each, so no label, however common, is one
    task's.

    Rows with a null id, label or vector, with a null or non-finite component or
    one of 2**20 or more take no part. Rows of another vector length than the
    anchor's do not meet it. A row that repeats an id is a row of its own, but
    one of the anchor's id is never its positive; anchors alike in all are one,
    and anchors of one id that differ answer each for itself. Other columns are
    ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.when(usable("embedding"), F.col("embedding")).alias("v")).where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    rows = cut(rows.withColumn("v", F.col("v").cast(f"array<{kind if kind in ('float', 'double') else 'double'}>")), "negatives-rows")
    name = F.concat_ws(":", "vec_id", "label", F.xxhash64("v"), F.hash("v"))
    anchors = cut(rows.where(F.col("vec_id") % every == 0).withColumn("anchor", name).groupBy("anchor").agg(*[F.first(c).alias(c) for c in ("vec_id", "label", "v")]), "negatives-anchors")
    shape = (-(-anchors.count() // anchor_block), -(-rows.count() // block))
    if not shape[0]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    row_path = _blocks(rows.withColumn("place", F.monotonically_increasing_id()), shape[1], "negatives-row-blocks", "place")
    anchor_path = _blocks(anchors, shape[0], "negatives-anchor-blocks", "anchor")
    near = cut(_first(_meetings(spark, anchor_path, row_path, shape, 0, positives), positives, "anchor"), "negatives-positives")
    upper = F.expr(f"score * {high} div 100")  # a positive below 0 has an empty window
    limits = near.where("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_set(upper), asc=False).alias("limits"))  # at most `positives` a row
    limited = _blocks(anchors.join(limits, "anchor"), shape[0], "negatives-limits", "anchor")
    best = _first(_meetings(spark, limited, row_path, shape, positives, negatives), negatives, "anchor", "slot")
    held = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "n", "vec_id", "score"))).alias("held"))  # at most positives x negatives
    window = near.where("score >= 0").join(limits, "anchor").join(held, "anchor").join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    own = F.array_position("limits", upper) - 1
    merged = F.slice(F.filter("held", lambda x: x["slot"] >= own), 1, negatives)
    told = F.filter(merged, lambda x: low * F.col("score") <= 100 * x["score"])
    return window.select("anchor_id", F.col("vec_id").alias("positive_id"), F.posexplode(told).alias("at", "x"), F.col("score").alias("positive_score")).select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score"))


#: ``mine`` after ``relabelled`` in DuckDB, for small tables of unique ids.
MINE_SQL = """
WITH ok AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= 1048576)) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""
