"""Mixture-controlled packing of documents into token sequences."""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.common import cut, text_batches

END_ID = 1


class Encoder:
    """Token ids of the byte-level BPE vocabulary, as little-endian unsigned 16-bit ids.

    Ids equal those of the ``tokenizers`` file of the same vocabulary: its split
    pattern is applied with ``re`` where the text holds only characters on which
    the two agree, and pieces seen before come from memory (``held`` of them at
    most); any other text goes through the library whole.
    """

    def __init__(self, held: int = 200_000):
        import base64
        import re

        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
        self.own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})
        self.pieces = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
        self.plain = re.compile(r"[\n -~À-ÖØ-öø-ɏ]*").fullmatch
        self.held, self.known = held, {}

    def __call__(self, text: str) -> bytes:
        if "<|endoftext|>" in text or not self.plain(text):
            return array("H", self.own.encode(text, allowed_special="all")).tobytes()
        known, out = self.known, []
        if len(known) > self.held:
            known.clear()
        for piece in self.pieces(text):
            ids = known.get(piece)
            if ids is None:
                ids = known[piece] = array("H", self.own._encode_single_piece(piece)).tobytes() if len(piece) < 200 else array("H", self.own.encode_ordinary(piece)).tobytes()
            out.append(ids)
        return b"".join(out)


def tokenize(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``source``, ``part``, ``start``, ``tokens``, ``ids``, written to the shared folder.

    ``ids`` holds the document's ids and the end id, two bytes each; ``start``
    counts the ids of the same source before it in the same written part. So a
    source's queue needs only the sum of each (source, part) to have a place for
    every token, and no text or id is ever shuffled.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        encode, so_far, part = Encoder(), {}, TaskContext.get().partitionId()
        for batch in text_batches(batches):
            ids, starts, sizes, sources = [], [], [], batch.column(1).to_pylist()
            for s, t in zip(sources, batch.column(2).to_pylist(), strict=True):
                got = encode(t or "") + END_ID.to_bytes(2, "little")
                ids.append(got)
                starts.append(so_far.get(s, 0))
                sizes.append(len(got) // 2)
                so_far[s] = starts[-1] + sizes[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([part] * batch.num_rows, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "source", "part", "start", "tokens", "ids"])

    return cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, source string, part int, start long, tokens long, ids binary"), "packing-ids")


class RoundRobin:
    """Deficit round-robin over source queues, in closed form.

    Every window takes its tokens from the queues in proportion to their
    weights. What a queue is owed beyond whole tokens, its deficit, is carried
    to the next window; when a queue runs dry, the others share on by weight. A
    token's turn is (its number + 1/2) / weight, all tokens are served in order
    of turn (ties by queue), and so the state after any number of windows
    follows from the totals alone: a task can start at any window.
    """

    def __init__(self, totals: list[int], weights: list[float], window: int):
        self.totals, self.weights, self.window = np.array(totals, dtype=np.int64), np.array(weights, dtype=np.float64), window
        self.total = int(self.totals.sum())
        dry = self.totals / self.weights
        self.breaks = np.unique(np.concatenate([[0.0], dry]))
        self.fluid = np.minimum(self.breaks[:, None] * self.weights[None, :], self.totals[None, :]).sum(axis=1)
        self.slack = (len(totals) + 2) / self.weights.min(initial=1.0) if len(totals) else 1.0

    def served(self, windows: np.ndarray) -> np.ndarray:
        """Tokens taken from each queue before each of these windows (windows x queues)."""
        goal = np.minimum(windows.astype(np.int64) * self.window, self.total)
        # The turn at which the goal is reached, first as if tokens were a fluid.
        near = np.interp(goal, self.fluid, self.breaks)
        lo, hi = np.maximum(near - self.slack, 0), near + self.slack
        below = self._at(lo)
        for _ in range(200):
            done = (below.sum(axis=1) == goal) | (hi - lo <= np.spacing(hi))
            if done.all():
                break
            mid = (lo + hi) / 2
            here = self._at(mid)
            over = here.sum(axis=1) > goal
            lo, hi, below = np.where(over | done, lo, mid), np.where(over & ~done, mid, hi), np.where((over | done)[:, None], below, here)
        most = self._at(hi)
        for q in range(len(self.totals)):  # queues tied at that turn are served in order
            below[:, q] += np.clip(goal - below.sum(axis=1), 0, most[:, q] - below[:, q])
        return below

    def near_window(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The window of a token of a queue, or one next to it where rounding decides."""
        turn = (token + 0.5) / self.weights[queue]
        return self._at(turn).sum(axis=1) // self.window

    def _at(self, turn: np.ndarray) -> np.ndarray:
        return np.minimum(np.floor(turn[:, None] * self.weights[None, :] + 0.5).astype(np.int64), self.totals[None, :])


def pack(docs: DataFrame, weights: dict[str | None, float] | None = None, length: int = 2048, window: int = 32, text: str = "text") -> DataFrame:
    """A row for every piece of every document: where its tokens stand.

    Columns: ``doc_id``, ``source``, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset``. A mixing window is ``window``
    sequences; it takes from every source's queue by ``weights`` (tokens of the
    source where none are given, so that all queues last to the end) and lays
    the sources one after another, so a document is cut only where its source's
    share or a sequence ends. Sequences hold ``length`` tokens; what is left at
    the very end goes to sequences of falling powers of two, so nothing is
    padded. A null text is its end id alone; a null source is a queue of its
    own; repeated rows are packed as often as they occur. An empty table gives
    an empty result.

    Only the token total of each source comes to the driver.
    """
    spark, tokens = docs.sparkSession, tokenize(docs, text)
    sums = tokens.groupBy("source", "part").agg(F.sum("tokens").alias("n"))
    totals = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    names = sorted(totals, key=lambda s: (s is None, s))
    plan = RoundRobin([totals[s] for s in names], [float((weights or totals).get(s, 1e-9)) for s in names], window * length)
    number, full = {s: k for k, s in enumerate(names)}, plan.total // length
    spare, at = [], full * length
    for bit in range(length.bit_length() - 1, -1, -1):
        if plan.total % length >> bit & 1:
            spare.append((at, 1 << bit))
            at += 1 << bit
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each source and part, written so that its size is known: the join goes by it.
    base = cut(sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.col("source").alias("s"), F.col("part").alias("p"), "base"), "packing-bases")
    placed = tokens.join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).select("doc_id", "source", (F.col("start") + F.col("base")).alias("start"), "tokens", "ids")

    def run(batches):
        for batch in text_batches(batches):
            if not batch.num_rows:
                continue
            out = [[] for _ in range(8)]
            sources, starts, sizes = batch.column(1).to_pylist(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            queue = np.array([number[s] for s in sources])
            lo = np.maximum(plan.near_window(queue, starts) - 1, 0)
            hi = plan.near_window(queue, starts + sizes - 1) + 1
            need = np.unique(np.concatenate([np.arange(a, b + 2) for a, b in zip(lo, hi, strict=True)]))
            table = plan.served(need)
            held = {int(w): k for k, w in enumerate(need)}
            for r in range(batch.num_rows):
                ids, q, a, n = np.frombuffer(batch.column(4)[r].as_buffer(), dtype="<u2").astype("<u4"), queue[r], int(starts[r]), int(sizes[r])
                left = n
                for w in range(int(lo[r]), int(hi[r]) + 1):
                    k = held[w]
                    first, last = max(a, int(table[k, q])), min(a + n, int(table[k + 1, q]))
                    # a queue's slice of a window stands after those of the queues before it
                    place = w * plan.window + int((table[k + 1, :q] - table[k, :q]).sum()) + first - int(table[k, q])
                    while first < last:
                        seq, off, room = locate(place, full, length, spare)
                        size = min(room, last - first)
                        for c, v in zip(out, (batch.column(0)[r].as_py(), sources[r], first - a, size, zlib.crc32(ids[first - a : first - a + size].tobytes()), n, seq, off), strict=True):
                            c.append(v)
                        first, place, left = first + size, place + size, left - size
                if left:
                    raise AssertionError("a document's windows were not all found")
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column(0).type), pa.array(out[1], pa.string()), *(pa.array(c, pa.int64()) for c in out[2:])], names=["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(run, schema) if names else spark.createDataFrame([], schema)


def locate(place: int, full: int, length: int, spare: list[tuple[int, int]]) -> tuple[int, int, int]:
    """Sequence, offset and room from there on of a place in the token stream."""
    if place < full * length:
        return place // length, place % length, length - place % length
    for k, (at, size) in enumerate(spare):
        if place < at + size:
            return full + k, place - at, at + size - place
    raise ValueError("beyond the last sequence")
