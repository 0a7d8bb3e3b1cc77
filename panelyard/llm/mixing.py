"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.common import cut, row_hash, whole_row

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    """Words of a whole text; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """A row for each source: ``source``, ``source_size``, ``target``.

    ``sizes`` has ``source`` and ``size``. Sources in code-point order, null
    last, take the weights in turn and share ``total`` times all words; no
    target goes above ``most`` times its source's size, and what that cuts off
    is shared again by weight until none is above. That end state is one level:
    sources with the least (most x size / weight) stand at their limit and the
    rest get weight times what remains over the remaining weights, so it is
    found by one running sum over the sources in that order.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # rows: one for each source
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    sums = sums.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int"))).withColumn("limit", most * F.col("source_size"))
    up = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    above, all_rows = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sums = sums.withColumn("budget", total * F.sum("source_size").over(all_rows)).withColumn("before", F.coalesce(F.sum("limit").over(above), F.lit(0.0))).withColumn("rest", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(above), F.lit(0.0)))
    level = (F.col("budget") - F.col("before")) / F.col("rest")
    full = sums.withColumn("level", level).withColumn("held", F.col("limit") <= F.col("weight") * F.col("level"))
    # The level that holds is the one at the first source that is not at its limit.
    free = F.min(F.when(~F.col("held"), F.struct((F.col("limit") / F.col("weight")).alias("key"), "level"))).over(all_rows)
    return full.withColumn("free", free).select("source", "source_size", F.when(F.col("free").isNull() | F.col("held"), F.col("limit")).otherwise(F.col("weight") * F.col("free.level")).alias("target"))


def copies(docs: DataFrame, targets: DataFrame, seed: str = "mix", digits: int = 2, tie: str | None = None) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``copies`` to rows that have ``source`` and ``size``.

    Within a source every document expects target / source_size copies. The
    documents stand in order of size class (four to each doubling), salt
    (``digits`` hex digits of a hash of the id), size and id; the prefix sum of
    their expected copies plus one offset for the source crosses a number of
    integers at each document, and so many copies are taken. Neighbours in that
    order are alike in size, so the words taken come near the target. The rank
    behind the prefix sum comes from counts of each (source, class, salt) and a
    rank within it: no source is ever one task's. The order is total up to
    rows equal in all of it (``tie`` is a column that tells apart rows of one or
    no id, as a hash of the row), and the offset comes from the source's name,
    so reruns agree. An empty source (all sizes 0) gets no copies.
    """
    rows = docs.withColumn("__class", F.expr("length(bin(size)) * 4 + (shiftright(size * 4, length(bin(size)) - 1) & 3)").cast("int"))
    rows = rows.withColumn("__salt", F.coalesce(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col(tie).cast("string") if tie else F.lit(None).cast("string"))), 1, digits), F.lit(""))).withColumn("__src", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    counts = rows.groupBy("__src", "__class", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__src").orderBy("__class", "__salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    goal = targets.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("__src"), "source_size", "target")
    # At most (size classes x salts) rows a source, and one row a source.
    base = counts.join(goal, "__src")
    rank = F.row_number().over(Window.partitionBy("__src", "__class", "__salt").orderBy("size", F.col("doc_id").asc_nulls_last(), *([tie] if tie else [])))
    out = rows.withColumn("__rank", rank).join(base, ["__src", "__class", "__salt"])
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("__src"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    end = (F.col("__before") + F.col("__rank")).cast("double")
    taken = F.floor(end * expected + offset) - F.floor((end - 1) * expected + offset)
    return out.withColumn("copies", taken.cast("long")).drop("__src", "__class", "__salt", "__rank", "__before")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), total: float = 1.5, most: float = 2.0, text: str = "text") -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` for every row of ``docs``.

    A null text has size 0; a null source is a source of its own; rows with a
    null or repeated id are documents like any other. No document is taken more
    than ceil(``most``) times. An empty table gives an empty result.
    """
    # Words are counted once: what follows reads ids, sources and sizes alone.
    sizes = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text).alias("size")), "mix-sizes")
    return copies(sizes, source_targets(sizes, weights, total, most))


def take(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: left out, once, or repeated; all columns as they were.

    Which rows are taken depends on their contents alone: rows of one id, or of
    none, stand in order of a hash of the whole row, so any order of the input
    gives the same texts.
    """
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size"), row_hash(docs).alias("__tie"), whole_row(docs).alias("__row"))
    out = copies(sized, source_targets(sized.select("source", "size"), weights, total, most), tie="__tie").where("copies > 0")
    return out.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")


#: ``mix`` in DuckDB, with the words taken.
MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS lim FROM s),
u AS (SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ()) AS budget,
  coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS below,
  sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS rest FROM w),
l AS (SELECT *, (budget - below) / rest AS level FROM u),
f AS (SELECT *, lim <= weight * level AS held FROM l),
t AS (SELECT source, source_size, CASE WHEN held OR (SELECT count(*) FROM f WHERE NOT held) = 0 THEN lim ELSE weight * (SELECT level FROM f WHERE NOT held ORDER BY lim / weight, source NULLS LAST LIMIT 1) END AS target FROM f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, coalesce('=' || d.source, '') AS src,
  row_number() OVER (PARTITION BY d.source ORDER BY length(bin(size)) * 4 + (((size * 4) >> (length(bin(size)) - 1)::BIGINT) & 3), coalesce(substr(md5(doc_id::VARCHAR), 1, 2), ''), size, doc_id NULLS LAST)::DOUBLE AS rn
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS expected, ('0x' || substr(md5('mix' || src), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS shift FROM r),
y AS (SELECT *, (floor(rn * expected + shift) - floor((rn - 1) * expected + shift))::BIGINT AS copies FROM x)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM y
"""
