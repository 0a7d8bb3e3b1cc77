"""Secrets in texts and in what is encoded in them, by a worklist of decoded layers."""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import unicodedata
import zlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import map_arrow

# The kinds in their order, their patterns, and the least length of group 2 (assign) or of the whole match.
KINDS = {
    "assign": (r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Shortest base64 run and shortest decoded text that can hold any of these.
LEAST_RUN, LEAST_TEXT = 16, 12
#: What a text's decoded layers may hold together: a fixed part and so many times its own length.
LAYER_CHARS, LAYER_TIMES = 1 << 24, 64

#: Whole runs are looked for at their beginnings alone, and of texts only those that hold a pattern's fixed part.
_KINDS = [
    ("assign", 0, re.compile(KINDS["assign"][0]), 2, 6, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    ("access", 1, re.compile(KINDS["access"][0]), 0, 20, ("akia",)),
    ("hex", 2, re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}"), 0, 24, ("",)),
]
#: A run of percent or \x bytes, a \u escape (in pairs where it is a surrogate), a numeric or basic named reference, and letters of full width or of mathematical alphabets.
_ESCAPE = re.compile(r"(?P<url>(?:%[0-9A-Fa-f]{2})+)|(?P<x>(?:\\x[0-9A-Fa-f]{2})+)|\\u[Dd][89ABab][0-9A-Fa-f]{2}\\u[Dd][C-Fc-f][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:amp|lt|gt|quot|apos);|[！-～\U0001d400-\U0001d7ff]")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_FULL = re.compile("[！-～\U0001d400-\U0001d7ff]")
_BASE64 = re.compile(rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{{60,}}(?:\r?\n[A-Za-z0-9+/_-]{{4,}})+|[A-Za-z0-9+/_-]{{{LEAST_RUN},}})")
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_READABLE = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){%d,}|(?:[\t\n\r\x20-\x7e]\x00){%d,}" % (LEAST_TEXT, LEAST_TEXT))


class Found(NamedTuple):
    """A secret: its kind, where it or what encodes it stands in the text (code points), the layers unwrapped, and itself."""

    start: int
    order: int
    end: int
    kind: str
    layers: tuple[str, ...]
    value: str


class Spans:
    """Where each place of a layer comes from in the source text."""

    def __init__(self, starts, ends=None):
        self.starts, self.ends = starts, ends

    @classmethod
    def whole(cls, start: int, end: int) -> Spans:
        """A layer of which every place comes from one span, as that of a compressed one."""
        return cls((start, end))

    def at(self, i: int, j: int) -> tuple[int, int]:
        """The span of the source that places i to j (exclusive) come from."""
        return self.starts if self.ends is None else (self.starts[i], self.ends[j - 1])


def matches(text: str):
    """(kind, start, end, value) of every match that is long enough: leftmost, not overlapping, kind by kind."""
    low = text.lower()
    for kind, order, pattern, group, least, parts in _KINDS:
        if any(p in low for p in parts):
            for m in pattern.finditer(text):
                if m.end(group) - m.start(group) >= least:
                    yield order, kind, m.start(), m.end(), m[group]


def escaped(text: str) -> bool:
    """Whether a text has an escape; most have not even its first character."""
    return any(c in text for c in "%\\&") and _ESCAPE.search(text) is not None or not text.isascii() and _FULL.search(text) is not None


def inflate(data: bytes, most: int) -> tuple[bytes, bool]:
    """What a compressed stream at the start of ``data`` holds, at most ``most`` bytes, and whether that is all; of a broken stream what comes before the break."""
    if data[:2] == b"\x1f\x8b" or data[:1] == b"\x78":
        unpack = zlib.decompressobj(47)
    elif data[:3] == b"BZh":
        unpack = bz2.BZ2Decompressor()
    elif data[:1] == b"\xfd":
        unpack = lzma.LZMADecompressor(memlimit=1 << 26)
    else:
        import zstandard

        try:
            with zstandard.ZstdDecompressor(max_window_size=1 << 26).stream_reader(data) as reader:
                out = reader.read(most + 1)
        except zstandard.ZstdError:
            return b"", True
        return out[:most], len(out) <= most
    out = bytearray()
    try:
        feed = data
        while len(out) <= most:
            piece = unpack.decompress(feed, max(1, min(1 << 16, most + 1 - len(out))))
            feed = getattr(unpack, "unconsumed_tail", b"")
            out += piece
            if unpack.eof or not piece and not feed:
                break
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
        pass
    return bytes(out[:most]), len(out) <= most


def unescaped(text: str, spans: Spans):
    """A line with its escapes replaced once: (text, spans, byte runs of it with a compressed stream as (bytes, start, end)); None without an escape."""
    out, starts, ends, streams, at = [], [], [], [], 0

    def put(chars, i, j):
        out.append(chars)
        lo, hi = spans.at(i, j)
        starts.extend([lo] * len(chars))
        ends.extend([hi] * len(chars))

    def keep(i, j):
        out.append(text[i:j])
        if spans.ends is not None:
            starts.extend(spans.starts[i:j])
            ends.extend(spans.ends[i:j])

    for m in _ESCAPE.finditer(text):
        keep(at, m.start())
        whole, at = m[0], m.end()
        if m["url"] or m["x"]:
            step = 3 if m["url"] else 4
            raw = bytes.fromhex(re.sub(r"%|\\x", "", whole))
            if _MAGIC.search(raw):
                streams.append((raw, *spans.at(m.start(), m.end())))
            i = m.start()
            for char in raw.decode("utf-8", "surrogateescape"):
                wide = step * len(char.encode("utf-8", "surrogateescape"))
                put(char, i, i + wide)
                i += wide
            continue
        if whole[0] == "\\":
            hexes = re.findall(r"[0-9A-Fa-f]+", whole)
            code = 0x10000 + ((int(hexes[0], 16) & 0x3FF) << 10) + (int(hexes[1], 16) & 0x3FF) if len(hexes) == 2 else int(hexes[0], 16)
        elif whole.startswith("&#"):
            code = int(whole[3:-1], 16) if whole[2] in "xX" else int(whole[2:-1])
        else:
            put(_NAMED[whole[1:-1]] if whole[0] == "&" else unicodedata.normalize("NFKC", whole), m.start(), m.end())
            continue
        put(chr(code) if code <= 0x10FFFF else whole, m.start(), m.end())
    if not out:
        return None
    keep(at, len(text))
    new = "".join(out)
    return None if new == text else (new, Spans(starts, ends) if spans.ends is not None else spans, streams)


def scan(text: str | None) -> tuple[list[Found], int]:
    """All secrets of a text and the number of layers left unopened for their size.

    The worklist starts with the text. Of each layer, every match is mapped to
    the span of the text that it comes from. Then the layer's lines with escapes
    (percent, ``\\x`` and ``\\u``, character references, letters of full width)
    give a layer with these replaced once, every base64 run, at each of its four
    alignments, the readable stretches that it decodes to, and every compressed
    stream in decoded bytes what it unpacks to, until nothing new comes. A layer
    of the same content and span is never opened twice, so streams that unpack
    to themselves end. All layers together hold at most LAYER_CHARS +
    LAYER_TIMES x the text's length: what would go beyond is not opened but
    counted, a stream that would is read up to a third of what is left. A secret found along several ways is one, with the fewest layers.
    """
    text = text or ""
    found: dict[tuple[str, int, int], Found] = {}
    budget, unopened, seen = LAYER_CHARS + LAYER_TIMES * len(text), 0, set()
    work: list[tuple[str | bytes, Spans, tuple[str, ...]]] = []

    def add(content, spans, layers):
        nonlocal budget, unopened
        if not content:
            return
        raw = content if isinstance(content, bytes) else content.encode("utf-8", "surrogatepass")
        key = (hashlib.blake2b(raw, digest_size=16).digest(), isinstance(content, bytes), spans.at(0, len(content)))
        if key in seen:
            return
        seen.add(key)
        if len(content) > budget:
            unopened += 1
            return
        budget -= len(content)
        work.append((content, spans, layers))

    def keep(content, spans, layers):
        for order, kind, i, j, value in matches(content):
            lo, hi = spans.at(i, j)
            held = found.get((kind, lo, hi))
            if held is None or len(layers) < len(held.layers):
                found[kind, lo, hi] = Found(lo, order, hi, kind, layers, value)

    def open_text(content, shift, spans, layers):
        """The layers of a text; ``shift`` is where it stands in the source if ``spans`` is None."""
        if escaped(content):
            at = 0
            for line in content.splitlines(keepends=True):
                if escaped(line):
                    own = Spans(range(shift + at, shift + at + len(line)), range(shift + at + 1, shift + at + len(line) + 1)) if spans is None else spans if spans.ends is None else Spans(spans.starts[at : at + len(line)], spans.ends[at : at + len(line)])
                    if got := unescaped(line, own):
                        new, placed, streams = got
                        add(new, placed, (*layers, "escapes"))
                        for raw, lo, hi in streams:
                            add(raw, Spans.whole(lo, hi), (*layers, "escapes"))
                at += len(line)
        for m in _BASE64.finditer(content):
            run = m[0]
            places = [i for i, c in enumerate(run, m.start()) if c not in "\r\n"]
            chars = run.translate({13: None, 10: None, 45: "+", 95: "/"})
            for k in range(4):
                usable = len(chars) - k
                usable -= usable % 4 == 1
                raw = base64.b64decode(chars[k : k + usable] + "=" * (-usable % 4))
                if not (_MAGIC.search(raw) or _READABLE.search(raw)):
                    continue
                if spans is not None and spans.ends is None:
                    own = spans
                else:
                    source = (lambda i: (shift + i, shift + i + 1)) if spans is None else (lambda i: (spans.starts[i], spans.ends[i]))
                    own = Spans([source(places[k + 8 * b // 6])[0] for b in range(len(raw))], [source(places[k + (8 * b + 7) // 6])[1] for b in range(len(raw))])
                add(raw, own, (*layers, "base64"))

    def open_bytes(raw, spans, layers):
        nonlocal unopened
        for m in _MAGIC.finditer(raw):
            got, all_of_it = inflate(raw[m.start() :], budget // 3)  # its text counts as well
            unopened += not all_of_it
            add(got, Spans.whole(*spans.at(m.start(), len(raw))), (*layers, "compressed"))
        for m in _READABLE.finditer(raw):
            wide = m[0][1:2] == b"\x00"
            chars = m[0][::2].decode() if wide else m[0].decode("utf-8", "surrogateescape")
            if spans.ends is None:
                own = spans
            else:
                sizes = [2 if wide else len(c.encode("utf-8", "surrogateescape")) for c in chars]
                own, at = Spans([], []), m.start()
                for n in sizes:
                    lo, hi = spans.at(at, at + n)
                    own.starts.append(lo)
                    own.ends.append(hi)
                    at += n
            add(chars, own, layers)

    for order, kind, i, j, value in matches(text):
        found[kind, i, j] = Found(i, order, j, kind, (), value)
    open_text(text, 0, None, ())
    while work:
        content, spans, layers = work.pop()
        if isinstance(content, bytes):
            open_bytes(content, spans, layers)
        else:
            keep(content, spans, layers)
            open_text(content, 0, spans, layers)
    return sorted(found.values()), unopened


FINDINGS = "array<struct<kind: string, start: long, end: long, layers: array<string>, value: string>>"
_FINDINGS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layers", pa.list_(pa.string())), ("value", pa.string())]))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``findings`` and ``unopened`` for every whole text.

    ``findings`` has kind, start, end (code points of the text, end exclusive),
    layers (empty for what stands in the text itself, else the ways unwrapped)
    and value, by start, kind and end. ``unopened`` counts layers that would
    unpack to more than the bound (see ``scan``): they are told, not dropped
    unseen. A null text is empty and has no finding; repeated rows and null ids
    have a row each, other columns are ignored, and an empty table gives an
    empty result. Texts are scanned where they are read: nothing is shuffled.
    """

    def start():
        def step(batch):
            got = [scan(t) for t in batch.column(1).to_pylist()]
            rows = [[{"kind": x.kind, "start": x.start, "end": x.end, "layers": list(x.layers), "value": x.value} for x in found] for found, _ in got]
            return [batch.column(0), pa.array(rows, _FINDINGS), [n for _, n in got]]

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", text), start, f"doc_id {kind}, findings {FINDINGS}, unopened long")


def joined(findings: Column) -> Column:
    """kind:start:end of every finding, joined by commas."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind and a digest of what stands in the texts themselves, and all spans as text."""
    base = F.filter("findings", lambda x: F.size(x["layers"]) == 0)
    kinds = F.transform(base, lambda x: x["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"), (F.size("findings") - F.size(base)).cast("long").alias("n_decoded"), "unopened")


def redacted(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``doc_id``, the text with every finding replaced by ``mark``, and how many places were; overlapping findings are one place, a null text stays null."""

    def start():
        def step(batch):
            out, counts = [], []
            for t in batch.column(1).to_pylist():
                pieces, at, upto, n = [], 0, -1, 0
                for x in scan(t)[0]:
                    if x.start >= upto:
                        pieces += [t[at : x.start], mark]
                        n += 1
                    upto = at = max(upto, x.end)
                out.append(None if t is None else "".join([*pieces, t[at:]]))
                counts.append(n)
            return [batch.column(0), out, counts]

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", text), start, f"doc_id {kind}, text string, n_redacted long")
