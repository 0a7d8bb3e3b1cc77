"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame functions alone."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Paragraphs in a section.
SECTION = 8
#: Marks that end a clause, of Latin and of East Asian writing.
MARKS = ".,;:!?。，、；：！？"
#: A clause: up to and with its closing marks and the blanks after them, or what is left of the line.
CLAUSE = f"[^{MARKS}]*[{MARKS}]+ *|[^{MARKS}]+"
#: A clause of more than LONG characters is cut further by its own content: after four to nine words at one whose last letter is among these, else after eight words; what has no spaces 32 characters on at a digit, vowel or upper-case letter, else whole.
LONG, LAST = 96, "abcdefghABCDEFGH01234"
FURTHER = f"(?:[^ ]{{0,64}} ){{3,8}}?[^ ]{{0,64}}?[{LAST}][^\\p{{L}}\\p{{N}} ]* |(?:[^ ]{{0,64}} ){{8}}|[^ ]{{32,64}}?[0-9aeiouA-Z]|[^ ]{{64}}|[^\u0001]+|\u0001"


def clauses(text: Column) -> Column:
    """The leaves: the clauses of every paragraph (line) of a text, in order, long ones cut further, each as its SHA-256 followed by its length.

    Where a leaf ends depends on what stands near, not on its place, so an edit
    changes the leaves that it touches and those beside it, in any script and
    without any punctuation. Leaves keep every character of the line.
    """
    parts = lambda c: F.when(F.length(c) > LONG, F.regexp_extract_all(c, F.lit(FURTHER), F.lit(0))).otherwise(F.array(c))
    pieces = lambda p: F.flatten(F.transform(F.regexp_extract_all(p, F.lit(CLAUSE), F.lit(0)), parts))
    return F.transform(F.split(text, "\n"), lambda p: F.transform(pieces(p), lambda c: F.concat(F.sha2(c, 256), F.length(c).cast("string"))))


def paragraphs(leaves: Column) -> Column:
    """SHA-256 over the leaves' digests and lengths of every paragraph."""
    return F.transform(leaves, lambda p: F.sha2(F.array_join(p, ""), 256))


def sections(nodes: Column) -> Column:
    """SHA-256 over the digests of each run of SECTION paragraphs."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / SECTION).cast("int")), lambda i: F.sha2(F.array_join(F.slice(nodes, i * SECTION + 1, F.lit(SECTION)), ""), 256))


def root(upper: Column) -> Column:
    """SHA-256 over the section digests: equal exactly for equal texts."""
    return F.sha2(F.array_join(upper, ""), 256)


def with_tree(rows: DataFrame, text: str, prefix: str) -> DataFrame:
    """``rows`` with the tree of a text column, level by level: ``{prefix}clauses``, ``...paragraphs``, ``...sections``, ``...root``."""
    level = lambda name: F.col(prefix + name)
    rows = rows.withColumn(prefix + "clauses", clauses(F.col(text)))
    rows = rows.withColumn(prefix + "paragraphs", paragraphs(level("clauses")))
    rows = rows.withColumn(prefix + "sections", sections(level("paragraphs")))
    return rows.withColumn(prefix + "root", root(level("sections")))


def numbered(leaves: Column) -> Column:
    """Leaves that occur again with the number of the occurrence behind them, so that they count as often as they stand."""
    runs = lambda x: F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i) != F.get(x, i - 1)))

    def tagged(x: Column, starts: Column) -> Column:
        return F.flatten(F.transform(starts, lambda s, j: F.transform(F.sequence(F.lit(1), F.coalesce(F.get(starts, j + 1), F.size(x)) - s), lambda k: F.when(k == 1, F.get(x, s)).otherwise(F.concat(F.get(x, s), F.lit("#"), k.cast("string"))))))

    # Bound to names by a transform over one element: each is made once.
    own = lambda x: F.get(F.transform(F.array(runs(x)), lambda starts: tagged(x, starts)), F.lit(0))
    again = F.get(F.transform(F.array(F.sort_array(leaves)), own), F.lit(0))
    return F.when(F.size(F.array_distinct(leaves)) == F.size(leaves), leaves).otherwise(again)


def nodes(prefix: str) -> Column:
    """The digests of all nodes of a tree, each followed by its weight: a leaf's length, 1 for a node above."""
    upper = F.concat(F.array(prefix + "root"), F.col(prefix + "sections"), F.col(prefix + "paragraphs"))
    return F.concat(F.transform(upper, lambda d: F.concat(d, F.lit("1"))), F.flatten(prefix + "clauses"))


def with_nodes(rows: DataFrame, text: str, prefix: str) -> DataFrame:
    """``rows`` with ``{prefix}root`` and ``{prefix}nodes`` of a text column, nodes that repeat numbered; column by column, so that each is made once."""
    kept = rows.columns
    rows = with_tree(rows, text, prefix).withColumn(prefix + "all", nodes(prefix))
    return rows.withColumn(prefix + "nodes", numbered(F.col(prefix + "all"))).select(*kept, prefix + "root", prefix + "nodes")


def weight(tree: Column) -> Column:
    """Characters that nodes stand for."""
    return F.aggregate(tree, F.lit(0).cast("long"), lambda a, x: a + F.substring_index(F.substring(x, 65, 40), "#", 1).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    """Share of two trees that both have (0 to 1), by weight; 1 exactly where the roots are equal.

    A branch that both trees have counts with all below it, wherever it stands;
    of a branch that differs the parts below are still compared. So a text of
    which half is unchanged is alike by about half.
    """
    return (2.0 * weight(F.array_intersect(a, b))) / (weight(a) + weight(b))


def trees(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint``, ``sections``, ``paragraphs`` and ``clauses`` of every whole text.

    A null text is taken as empty; an empty text is one paragraph without a
    leaf. Repeated rows give equal rows; other columns are ignored.
    """
    rows = with_tree(docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("__t")), "__t", "")
    return rows.select("doc_id", F.col("root").alias("fingerprint"), "sections", "paragraphs", "clauses")


def locate_edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """Where two versions' trees differ: ``doc_id``, ``section``, ``paragraph``, ``change``.

    Both sides are results of ``trees``. Equal roots are left at once; then only
    sections with differing digests are opened, and of those the paragraphs that
    differ are named (both numbers from 0). ``change`` is edited, added or
    removed. Documents that only one side has are not compared.
    """
    pairs = before.select("doc_id", F.col("fingerprint").alias("f0"), F.col("sections").alias("s0"), F.col("paragraphs").alias("p0")).join(after.select("doc_id", F.col("fingerprint").alias("f1"), F.col("sections").alias("s1"), F.col("paragraphs").alias("p1")), "doc_id").where("f0 <> f1")
    opened = pairs.select("doc_id", "p0", "p1", F.explode(F.filter(F.sequence(F.lit(0), F.greatest(F.size("s0"), F.size("s1")) - 1), lambda i: ~F.get("s0", i).eqNullSafe(F.get("s1", i)))).alias("section"))
    named = opened.select("doc_id", "section", F.explode(F.transform(F.sequence(F.lit(0), F.lit(SECTION - 1)), lambda i: F.struct((F.col("section") * SECTION + i).alias("n"), F.get("p0", F.col("section") * SECTION + i).alias("a"), F.get("p1", F.col("section") * SECTION + i).alias("b")))).alias("x"))
    change = F.when(F.col("x.a").isNull(), "added").when(F.col("x.b").isNull(), "removed").otherwise("edited")
    return named.where(~F.col("x.a").eqNullSafe(F.col("x.b"))).select("doc_id", "section", F.col("x.n").alias("paragraph"), change.alias("change"))


def with_next(docs: DataFrame, text: str = "text", more: Callable[[DataFrame], DataFrame] | None = None, chunk_rows: int = 4_096, most_chunks: int = 32_768) -> DataFrame:
    """``doc_id``, ``text`` and ``next_text``, that of the next document by id (after the last: the first).

    ``more`` may add a column ``tree`` from ``text`` once a row; it is made where
    the rows have been dealt to, and ``next_tree`` is the next document's.

    Ids of any orderable type; null ids come first, and rows of one id are
    ordered by a hash of their text. Rows are cut into ranges of like row count
    by sampled bounds on id and hash, so neither ids that lie close nor a common
    or null id fill one range. A window in each range looks one row ahead, and
    the first row of a range also stands at the end of the range before: no
    global order is needed and every text is shuffled once. Of tables of more
    than ``chunk_rows`` times ``most_chunks`` rows the ranges grow; they are
    sorted with spill and read as a stream. Only the bounds and Spark's sample for
    them, 100 ids a range, reach the driver.
    """
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("k", F.struct("doc_id", F.xxhash64("text").alias("h")))
    parts = max(1, min(most_chunks, docs.count() // chunk_rows))
    least = rows.select("k").repartitionByRange(parts, "k.doc_id", "k.h").groupBy(F.spark_partition_id()).agg(F.min("k").alias("k"))
    bounds = json.loads(least.agg(F.to_json(F.array_sort(F.collect_list("k")))).first()[0])  # one for each range
    if not bounds:
        rows = rows.select("doc_id", "text", F.lit(None).cast("string").alias("next_text"))
        return more(rows).withColumn("next_tree", F.col("tree")) if more else rows
    width = math.isqrt(len(bounds) - 1) + 1
    kind = rows.schema["k"].dataType.simpleString()
    held = F.from_json(F.lit(json.dumps([bounds[at : at + width] for at in range(0, len(bounds), width)])), f"array<array<{kind}>>")
    upto = lambda bs: F.size(F.filter(bs, lambda b: b <= F.col("k")))
    rows = rows.withColumn("o", upto(F.transform(held, lambda bs: bs[0]))).withColumn("bs", F.element_at(held, F.col("o"))).withColumn("i", upto(F.col("bs")))
    chunk = (F.col("o") - 1) * width + F.col("i") - 1
    own = F.struct(chunk.alias("chunk"), F.lit(0).alias("wraps"), F.lit(False).alias("extra"))
    also = F.struct(F.when(chunk > 0, chunk - 1).otherwise(len(bounds) - 1).alias("chunk"), (chunk == 0).cast("int").alias("wraps"), F.lit(True).alias("extra"))
    stood = rows.select("k", "text", F.inline(F.when(F.element_at("bs", F.col("i")) == F.col("k"), F.array(own, also)).otherwise(F.array(own))))
    ahead = Window.partitionBy("chunk").orderBy("wraps", "k", "extra")
    if more:
        stood = more(stood.repartition("chunk")).withColumn("next_tree", F.lead("tree").over(ahead))
    return stood.withColumn("next_text", F.lead("text").over(ahead)).where("NOT extra").select("k.doc_id", "text", "next_text", *(["tree", "next_tree"] if more else []))


def edited(text: Column, following: Column) -> Column:
    """The text with its last half (rounded down) replaced by the start of the following one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def compare_with_edit(docs: DataFrame, text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how near the trees are.

    A null text is taken as empty. Rows that share an id each have a row.
    """


    def own(rows: DataFrame) -> DataFrame:
        return with_nodes(rows, "text", "own_").withColumn("tree", F.struct("own_root", "own_nodes")).drop("own_root", "own_nodes")

    rows = with_nodes(with_next(docs, text, own).withColumn("edit", edited(F.col("text"), F.col("next_text"))), "edit", "edit_")
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"), F.col("tree.own_root").alias("fingerprint"), F.col("edit_root").alias("edited_fingerprint"), F.col("tree.own_nodes").alias("own"), F.col("edit_nodes").alias("edit"), F.col("next_tree.own_nodes").alias("next"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("own"), F.col("edit")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))


def _tree_sql(text: str, k: int) -> str:
    return f"""
l{k} AS (SELECT doc_id, list_transform(string_split({text}, chr(10)), lambda x: list_transform(flatten(list_transform(regexp_extract_all(x, '{CLAUSE}'), lambda c: CASE WHEN length(c) > {LONG} THEN regexp_extract_all(c, '{FURTHER}') ELSE [c] END)), lambda c: sha256(c) || length(c))) AS c FROM e),
p{k} AS (SELECT doc_id, c, list_transform(c, lambda x: sha256(array_to_string(x, ''))) AS p FROM l{k}),
s{k} AS (SELECT doc_id, c, p, list_transform(range(0, (len(p) - 1) // 8 + 1), lambda i: sha256(array_to_string(p[i * 8 + 1 : i * 8 + 8], ''))) AS s FROM p{k}),
n{k} AS (SELECT doc_id, sha256(array_to_string(s, '')) AS root, list_concat(list_transform(list_concat([sha256(array_to_string(s, ''))], list_concat(s, p)), lambda d: d || '1'), flatten(c)) AS nodes FROM s{k}),
m{k} AS (SELECT doc_id, any_value(root) AS root, list(x || CASE WHEN n > 1 THEN '#' || n ELSE '' END) AS nodes FROM (SELECT doc_id, root, x, row_number() OVER (PARTITION BY doc_id, x) AS n FROM (SELECT doc_id, root, unnest(nodes) AS x FROM n{k})) GROUP BY doc_id)"""


def _weight_sql(nodes: str) -> str:
    return f"coalesce(list_sum(list_transform({nodes}, lambda d: string_split(substr(d, 65), '#')[1]::BIGINT)), 0)"


#: The same in DuckDB, for tables of unique ids.
COMPARE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next_text FROM t),
e AS (SELECT *, substring(text, 1, length(text) - length(text) // 2) || substring(next_text, 1, length(text) // 2) AS edited FROM n),{_tree_sql("text", 0)},{_tree_sql("edited", 1)},{_tree_sql("next_text", 2)}
SELECT e.doc_id, length(e.text) AS n_chars, sha256(e.edited) AS edited_sha256, m0.root AS fingerprint, m1.root AS edited_fingerprint,
  (2.0::DOUBLE * {_weight_sql("list_intersect(m0.nodes, m1.nodes)")}) / ({_weight_sql("m0.nodes")} + {_weight_sql("m1.nodes")}) AS near_edited,
  (2.0::DOUBLE * {_weight_sql("list_intersect(m0.nodes, m2.nodes)")}) / ({_weight_sql("m0.nodes")} + {_weight_sql("m2.nodes")}) AS near_next
FROM e JOIN m0 USING (doc_id) JOIN m1 USING (doc_id) JOIN m2 USING (doc_id)
"""
