"""WARC archives with a two-level capture index."""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import cut, scratch_path, text_batches

#: Payloads below this many bytes are always stored.
LEAST_REVISIT = 100
#: Bytes of an archive file, and captures in a compressed index block.
FILE_BYTES, BLOCK_LINES = 1 << 28, 512
#: Captures of an index part, where that gives more parts than a shuffle has: bounds the directory that a task holds.
PART_LINES = 131_072
_NAMES = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")


def capture_key(url: str | None) -> str:
    """A URL's key: scheme dropped, host labels reversed, then port, path and query.

    ``https://blog.example.com:81/a?b#c`` becomes ``com,example,blog:81)/a?b``.
    A null URL has the empty key; white space is written as %20.
    """
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^@/?#]*@)?([^/?#:]*)(:\d+)?([^#]*)", url or "", re.S)
    host = ",".join(reversed(m[1].lower().split("."))) if m[1] else ""
    if not host and not m[3]:
        return ""
    return re.sub(r"\s", "%20", f"{host}{m[2] or ''}){m[3] or '/'}")


def decide(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``pages`` with ``payload_digest``, ``payload_bytes``, ``record_type`` and ``refers_to``.

    Of equal payloads of at least LEAST_REVISIT bytes the smallest id is the
    response and the others revisit it. A null payload is empty. Rows that
    repeat the smallest id are all responses.
    """
    data = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.withColumn("payload_digest", F.sha2(data, 256)).withColumn("payload_bytes", F.octet_length(data).cast("long"))
    twice = rows.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.min(key).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    rows = rows.join(twice, "payload_digest", "left")
    again = F.col("__first").isNotNull() & ~F.col(key).eqNullSafe(F.col("__first"))
    return rows.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("__first"))).drop("__first")


def _escaped(value) -> str:
    return re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def _plain(value: str | None) -> str | None:
    return None if value is None else unquote(value, errors="surrogatepass")


def record(page_id, url, html: str | None, digest: str, revisit_of, date: str) -> bytes:
    """One WARC/1.1 record, uncompressed. A revisit keeps the headers of its response and no payload."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    ident = lambda x: f"<urn:uuid:{uuid.uuid5(_NAMES, str(x))}>"
    head = [("WARC-Type", "response" if revisit_of is None else "revisit"), ("WARC-Record-ID", ident(page_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url)))
    head += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if page_id is not None:
        head.append(("WARC-Page-ID", _escaped(page_id)))
    if revisit_of is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", ident(revisit_of)), ("WARC-Refers-To-Page-ID", _escaped(revisit_of))]
        payload = b""
    head.append(("Content-Length", str(len(http) + len(payload))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + http + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers, the HTTP Content-Length and the payload of one record."""
    top, _, rest = data.partition(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in top.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http, _, payload = rest[: int(head["Content-Length"])].partition(b"\r\n\r\n")
    return head, int(re.search(rb"Content-Length: (\d+)", http)[1]), payload


def write_archives(decided: DataFrame, folder: str, key: str = "page_id", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for every row, each a gzip member of its own, and returns the captures.

    ``cap_key``, ``page_id``, ``file``, ``offset``, ``length``; written to the
    shared folder, so every file is written once. A task's attempts write files
    of their own names and only those of the attempt that counted are listed.
    """
    kind = decided.schema[key].dataType.simpleString()

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in text_batches(batches):
            rows = []
            for page, url, html, digest, refers in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if out is None or at >= FILE_BYTES:
                    if out:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                z = zlib.compressobj(4, zlib.DEFLATED, 31)
                data = z.compress(record(page, url, html, digest, refers, date)) + z.flush()
                out.write(data)
                rows.append((capture_key(url), page, name, at, len(data)))
                at += len(data)
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], batch.column(0).type), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["cap_key", "page_id", "file", "offset", "length"])
        if out:
            out.close()

    return cut(decided.select(key, "url", "html", "payload_digest", "refers_to").mapInArrow(run, f"cap_key string, page_id {kind}, file string, offset long, length long"), "warc-captures")


def build_index(captures: DataFrame, folder: str, parts: int | None = None) -> DataFrame:
    """Sorts captures by key into compressed blocks and returns the sparse directory of blocks.

    Every index part is a file of zlib blocks of BLOCK_LINES lines. The
    directory has, for each block, ``first``, ``last``, ``file``, ``offset``,
    ``length`` and its place (``part``, ``seq``).
    """
    spark = captures.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // PART_LINES))
    ordered = captures.repartitionByRange(parts, "cap_key", "file", "offset").sortWithinPartitions("cap_key", "file", "offset")

    def run(batches):
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, name, at, seq, out, lines = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.idx", 0, 0, None, []

        def block(lines):
            nonlocal at, seq
            data = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 6)
            out.write(data)
            row = (lines[0].split(" ", 1)[0], lines[-1].split(" ", 1)[0], name, at, len(data), part, seq)
            at, seq = at + len(data), seq + 1
            return row

        def told(rows):
            c = list(zip(*rows, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([*(pa.array(c[k], pa.string()) for k in range(3)), *(pa.array(c[k], pa.int64()) for k in (3, 4)), *(pa.array(c[k], pa.int32()) for k in (5, 6))], names=["first", "last", "file", "offset", "length", "part", "seq"])

        for batch in text_batches(batches, 4096):
            out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
            lines += [f"{k} {f} {o} {n}" for k, f, o, n in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)]
            while len(lines) >= BLOCK_LINES:
                yield told([block(lines[:BLOCK_LINES])])
                lines = lines[BLOCK_LINES:]
        if lines:
            yield told([block(lines)])
        if out:
            out.close()

    return cut(ordered.select("cap_key", "file", "offset", "length").mapInArrow(run, "first string, last string, file string, offset long, length long, part int, seq int"), "warc-directory")


def lookup(keys: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """The captures of each key of ``keys`` (``cap_key``, each once): ``file``, ``offset``, ``length``.

    A key goes to the index parts whose range holds it (a bounded list, one
    entry a part), there by binary search to the blocks that may hold it, and
    each block is fetched by one range read and searched the same way. A key
    with very many captures is spread over its blocks.
    """
    spans = sorted((r["lo"], r["hi"], r["part"]) for r in directory.groupBy("part").agg(F.min("first").alias("lo"), F.max("last").alias("hi")).collect())

    def to_parts(batches):
        # Parts are sorted and meet at most at their ends, so their ends rise, too.
        starts, ends = [s[0].encode("utf-8", "surrogatepass") for s in spans], [s[1].encode("utf-8", "surrogatepass") for s in spans]
        for batch in text_batches(batches, 4096):
            ks, ps = [], []
            for k in batch.column(0).to_pylist():
                b = k.encode("utf-8", "surrogatepass")
                for p in range(bisect.bisect_left(ends, b), bisect.bisect_right(starts, b)):
                    ks.append(k)
                    ps.append(spans[p][2])
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.string()), pa.array(ps, pa.int32())], names=["cap_key", "part"])

    wanted = keys.select("cap_key").mapInArrow(to_parts, "cap_key string, part int")
    # The directory of a part comes before the keys that are sought in it; only that much is held at a time.
    entries = directory.select("part", "seq", "first", "last", "file", "offset", "length", F.lit(None).cast("string").alias("cap_key"))
    both = entries.unionByName(wanted, allowMissingColumns=True)
    width = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(width, "part").sortWithinPartitions("part", F.col("seq").asc_nulls_last())

    def to_blocks(batches):
        now, starts, ends, places = None, [], [], []
        for batch in text_batches(batches, 4096):
            out = [], [], [], []
            for part, _, first, last, file, offset, length, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    now, starts, ends, places = part, [], [], []
                if k is None:
                    starts.append(first.encode("utf-8", "surrogatepass")), ends.append(last.encode("utf-8", "surrogatepass")), places.append((file, offset, length))
                    continue
                b = k.encode("utf-8", "surrogatepass")
                for p in range(bisect.bisect_left(ends, b), bisect.bisect_right(starts, b)):
                    for c, v in zip(out, (k, *places[p]), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["cap_key", "file", "offset", "length"])

    found = both.mapInArrow(to_blocks, "cap_key string, file string, offset long, length long")
    dealt = found.repartition(width, "file", "offset").sortWithinPartitions("file", "offset", "cap_key")

    def to_captures(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        held, names, lines, source = None, [], [], (None, None)
        for batch in text_batches(batches, 1024):
            fs_, os_, ns_ = [], [], []
            for k, f, o, n in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if held != (f, o):
                    if source[0] != f:
                        source = (f, fs.open_input_file(f"{root}/{f}"))
                    lines = zlib.decompress(source[1].read_at(n, o)).split(b"\n")
                    names, held = [x.split(b" ", 1)[0] for x in lines], (f, o)
                b = k.encode("utf-8", "surrogatepass")
                for p in range(bisect.bisect_left(names, b), bisect.bisect_right(names, b)):
                    _, file, at, size = lines[p].decode().rsplit(" ", 3)
                    fs_.append(file), os_.append(int(at)), ns_.append(int(size))
            yield pa.RecordBatch.from_arrays([pa.array(fs_, pa.string()), pa.array(os_, pa.int64()), pa.array(ns_, pa.int64())], names=["file", "offset", "length"])

    return dealt.mapInArrow(to_captures, "file string, offset long, length long")


def read_records(captures: DataFrame, folder: str, kind: str = "bigint") -> DataFrame:
    """``page_id``, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` and ``payload``.

    Captures (``file``, ``offset``, ``length``) are put in file order and read by
    range. A response's length and digest come from its payload, which must
    agree with the record's header; a revisit's come from its headers, and its
    payload is null.
    """
    width = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(width, "file", "offset").sortWithinPartitions("file", "offset").select("file", "offset", "length")

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        source = (None, None)
        for batch in text_batches(batches, 128):
            rows = []
            for f, o, n in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if source[0] != f:
                    source = (f, fs.open_input_file(f"{root}/{f}"))
                head, size, payload = parse(zlib.decompress(source[1].read_at(n, o), 31))
                digest, revisit = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"] == "revisit"
                if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"record at {f}:{o} is damaged")
                rows.append((_plain(head.get("WARC-Page-ID")), head.get("WARC-Target-URI"), size, digest, head["WARC-Type"], _plain(head.get("WARC-Refers-To-Page-ID")), None if revisit else payload))
            c = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.string()), pa.array(c[4], pa.string()), pa.array(c[5], pa.string()), pa.array(c[6], pa.binary())], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    got = ordered.mapInArrow(run, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    return got.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives all pages, indexes the archives, looks every page's URL up and reads its records back.

    Null URLs share the empty key. An empty table gives an empty result.
    """
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType.simpleString()
    folder = scratch_path(spark, "warc")
    captures = write_archives(decide(pages.select("page_id", "url", "html")), folder)
    directory = build_index(captures, f"{folder}/index")

    def keyed(batches):
        for batch in text_batches(batches, 4096):
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u) for u in batch.column(0).to_pylist()], pa.string())], names=["cap_key"])

    keys = pages.select("url").mapInArrow(keyed, "cap_key string").distinct()
    return read_records(lookup(keys, directory, f"{folder}/index"), folder, kind)


#: The result of ``round_trip`` without URL and payload, in DuckDB.
ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""
