"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import id_crc32, map_arrow, text_batches

#: Texts are compressed whole, in blocks of this many bytes, so that the dictionary counts all along a long text.
BLOCK = 8192
_BREAK, _ASCII_BREAK = regex.compile(r"[^\p{L}\p{M}]+"), re.compile(r"[^a-z]+")


def plain(text: str | None) -> str:
    """Lower-cased letters and their marks (Unicode L and M), with one space for whatever stands between them."""
    low = (text or "").lower()
    return (_ASCII_BREAK if low.isascii() else _BREAK).sub(" ", low).strip()


def fit(labelled: DataFrame, rows: int = 512, chars: int = 256) -> dict[str, bytes]:
    """A raw-content dictionary for each non-null ``lang`` of ``labelled`` (``doc_id``, ``text``, ``lang``).

    A bounded sample is enough for a dictionary: of each language the ``rows``
    rows with the smallest hashes, ``chars`` characters from a hashed place in
    each, all joined. Languages are counted first, so each partition sends on
    only the rows below its language's hash limit, about twice as many as are
    used, and repeated rows count once. A language without a text has a
    dictionary of one space; no language, none.
    """
    named = labelled.where("lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    rare = named.where("text IS NOT NULL").select("lang", "text", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(2**31)).alias("h"))
    limit = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(2**31, int(2 * rows / n * 2**31) + 1))) for lang, n in sorted(counts.items())])
    part = F.expr(f"substring(text, cast(h % (greatest(length(text) - {chars}, 0) + 1) as int) + 1, {chars})")
    best = rare.where(F.col("h") < limit).groupBy("lang", "h").agg(F.min(part).alias("part"))
    parts: dict[str, list[tuple[int, str]]] = {}
    for r in best.collect():
        parts.setdefault(r["lang"], []).append((r["h"], r["part"]))
    return {lang: " ".join(plain(p) for _, p in sorted(parts.get(lang, []))[:rows]).encode("utf-8", "surrogatepass") or b" " for lang in sorted(counts)}


def classifier(dictionaries: dict[str, bytes], level: int = 6):
    """A function from a text to (language, score, margin); ("und", 0, 0) without a letter or a language.

    Every block of the text, whatever its length, is compressed with each
    language's dictionary; the language with the smallest total wins, on a tie
    the first by name. The margin is the bytes that the next language needs
    above it, as a share; the score is that margin over the margin plus 0.02.
    """
    import zstandard

    def compressor(content):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_dict_id=False).compress

    ready = [(lang, compressor(content)) for lang, content in sorted(dictionaries.items())]

    def classify(text):
        letters = plain(text)
        if not ready or not any(map(str.isalpha, letters)):  # marks alone are no letter
            return "und", 0.0, 0.0
        data = letters.encode("utf-8", "surrogatepass")
        sizes = sorted((sum(len(compress(data[at : at + BLOCK])) for at in range(0, len(data), BLOCK)), lang) for lang, compress in ready)
        if len(sizes) == 1:
            return sizes[0][1], 1.0, 1.0
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return sizes[0][1], margin / (margin + 0.02), margin

    return classify


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", least_margin: float = 0.004) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score``, ``margin`` and ``accepted`` for every whole text.

    A text that is null or has no letter is ``und`` with score 0 and is not
    accepted; neither is one whose margin is below ``least_margin``. Repeated
    rows give equal rows, other columns are ignored, and an empty table gives an
    empty result.
    """

    def start():
        classify = classifier(dictionaries)

        def step(batch):
            got = [classify(t) for t in batch.column(1).to_pylist()]
            return [batch.column(0), *([g[k] for g in got] for k in range(3)), [g[0] != "und" and g[2] >= least_margin for g in got]]

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", text), start, f"doc_id {kind}, lang_pred string, score double, margin double, accepted boolean")


def training_rows(docs: DataFrame, held_out: int = 2, folds: int = 4) -> DataFrame:
    """Rows outside the held-out fold (crc32 of the id as text, modulo ``folds``)."""
    return docs.select("doc_id", "text", "lang").where(id_crc32() % folds != held_out)


def keep_known(docs: DataFrame, dictionaries: dict[str, bytes], least_margin: float = 0.004) -> DataFrame:
    """The rows of ``docs`` whose language is told with a margin, all columns as they were.

    Texts that are null or have no letter go; repeated rows stay or go together.
    """

    def run(batches):
        classify = classifier(dictionaries)
        for batch in text_batches(batches):
            at = batch.schema.get_field_index("text")
            got = [classify(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([g[0] != "und" and g[2] >= least_margin for g in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
