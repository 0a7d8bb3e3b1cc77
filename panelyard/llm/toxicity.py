"""Toxicity by the nearest labelled examples under exact TF-IDF cosine."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from panelyard.llm.common import cut, id_crc32, map_arrow, ship, spread_sample, text_batches

#: Examples stand in aligned blocks of this many, each with its largest weight of every common feature.
BLOCK = 16
#: Blocks of the largest bounds that are finished before the k-th best cosine is taken as the least.
FIRST = 4
#: A feature that more than one in this many examples hold is common: block maxima bound its part.
COMMON = 8
#: Neighbours that vote, and the votes that the share of toxic rows counts for.
NEIGHBOURS, PRIOR_VOTES = 15, 0.05
#: What marks a prefix; no word ends with it.
PREFIX = "*"
_EDGE = ".,;:!?\"'()[]{}<>*-_/\\#$%&"


def word_features(token: str) -> tuple[str, ...]:
    """A word without outer punctuation and, of a longer one, its first five letters (as "first*")."""
    word = token.strip(_EDGE)
    if not word:
        return ()
    return (word, word[:5] + PREFIX) if len(word) > 5 else (word,)


def feature_counts(texts: pa.Array, numbers: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature number, count) of every known feature of whole texts, sorted by row and number."""
    tokens = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
    coded = tokens.flatten().dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False)
    words = pc.utf8_trim(coded.dictionary, _EDGE)
    known = np.full((max(1, len(words)), 2), -1, dtype=np.int64)
    for j, names in enumerate((words, pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, 5), PREFIX, ""))):
        known[: len(words), j] = [numbers.get(w, -1) for w in names.to_numpy(zero_copy_only=False).tolist()]
    known[: len(words), 1][pc.utf8_length(words).to_numpy(zero_copy_only=False) <= 5] = -1
    size = max(1, len(numbers))
    keys = [row[hit] * size + f[hit] for f in (known[at, 0], known[at, 1]) for hit in [f >= 0]]
    both, counts = np.unique(np.concatenate(keys), return_counts=True)
    return both // size, both % size, counts


class ExampleIndex:
    """Labelled examples in an inverted index with block maxima.

    A feature weighs (1 + log count) times its weight, and vectors have length
    one. Rare features have postings (example, weight), which are summed whole.
    Common features, which tell little and have the long lists, have the
    largest weight in every aligned block of examples. The sums of a block and
    its maxima bound its cosines: a block gets its common features' part only
    where its bound reaches the k-th best cosine known so far. So the k best are
    exactly those of a full scan (of equal cosines the smaller position).
    """

    def __init__(self, names: list[str], weights: np.ndarray, ids: pa.Array, keys: np.ndarray, labels: np.ndarray, rows: np.ndarray, cols: np.ndarray, counts: np.ndarray, prior: float):
        self.prior, n, size = prior, len(labels), len(names)
        held = np.bincount(cols, minlength=size)
        order = np.argsort(held, kind="stable")  # rare features first
        place = np.empty(size, dtype=np.int64)
        place[order] = np.arange(size)
        self.numbers = {names[f]: k for k, f in enumerate(order.tolist())}
        self.weights, self.first = weights[order], int(np.searchsorted(held[order], n / COMMON, side="right"))
        cols = place[cols]
        vals = (1 + np.log(counts)) * self.weights[cols]
        norm = np.sqrt(np.bincount(rows, weights=vals * vals, minlength=n))
        vals = vals / norm[rows] if len(rows) else vals
        # Examples led by the same feature stand together, so that block maxima tell blocks apart.
        by = np.lexsort((cols, -vals, rows))
        lead = np.full(n, size, dtype=np.int64)
        lead[rows[by][::-1]] = cols[by][::-1]
        put = np.argsort(lead, kind="stable")
        back = np.empty(n, dtype=np.int64)
        back[put] = np.arange(n)
        self.ids, self.labels, rows = ids.take(pa.array(put, pa.int64())), labels[put].astype(np.float64), back[rows]
        self.places = {h: k for k, h in enumerate(keys[put].tolist())}
        by = np.lexsort((rows, cols))
        rows, cols, vals = rows[by], cols[by], vals[by]
        self.starts = np.searchsorted(cols, np.arange(self.first + 1))
        end = int(self.starts[-1])
        self.rows, self.vals = rows[:end].astype(np.int32), vals[:end]
        self.common = (rows[end:].astype(np.int32), (cols[end:] - self.first).astype(np.int32), vals[end:])
        self.slope, self.shift, self._dense = 1.0, 0.0, None

    def __getstate__(self):
        return self.__dict__ | {"_dense": None}

    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of common features by example, and their maxima by block."""
        if self._dense is None:
            rows, cols, vals = self.common
            table = np.zeros((len(self.labels), len(self.weights) - self.first))
            table[rows, cols] = vals
            maxima = np.zeros((table.shape[1], -(-len(table) // BLOCK)))
            np.maximum.at(maxima, (cols, rows // BLOCK), vals)
            self._dense = table, maxima
        return self._dense

    def nearest(self, texts: pa.Array, k: int = NEIGHBOURS, skip: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every text the cosines and positions of its ``k`` nearest examples with a positive cosine, without position ``skip``."""
        n, size, none = len(self.labels), len(texts), (np.zeros(0), np.zeros(0, dtype=np.int64))
        if not n or not size:
            return [none] * size
        rows, cols, counts = feature_counts(texts, self.numbers)
        vals = (1 + np.log(counts)) * self.weights[cols]
        vals = vals / np.sqrt(np.bincount(rows, weights=vals * vals, minlength=size))[rows]
        table, maxima = self.dense()
        blocks = maxima.shape[1]
        wide = np.zeros((size, table.shape[1]))
        far = cols >= self.first
        wide[rows[far], cols[far] - self.first] = vals[far]
        ends = np.searchsorted(rows, np.arange(size + 1))
        score = np.zeros((size, blocks * BLOCK))
        for r in range(size):
            at = slice(ends[r], ends[r] + int(np.searchsorted(cols[ends[r] : ends[r + 1]], self.first)))
            lo = self.starts[cols[at]]
            many = self.starts[cols[at] + 1] - lo
            spots = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
            score[r, :n] = np.bincount(self.rows[spots], weights=np.repeat(vals[at], many) * self.vals[spots], minlength=n)
        if skip is not None:
            score[np.arange(size), skip] = -2.0
        bound = score.reshape(size, blocks, BLOCK).max(axis=2) + wide @ maxima
        todo = np.zeros((size, blocks), dtype=bool)
        first = np.argpartition(-bound, min(FIRST, blocks) - 1, axis=1)[:, :FIRST]
        np.put_along_axis(todo, first, True, axis=1)
        done = todo.copy()
        self._finish(score, wide, table, todo)
        if n > k:
            least = np.partition(score, -k, axis=1)[:, -k]
            todo = (bound >= least[:, None] - 1e-12) & ~done
            self._finish(score, wide, table, todo)
        score = score[:, :n]
        near = np.argpartition(-score, k - 1, axis=1)[:, :k] if n > k else np.tile(np.arange(n), (size, 1))
        out = []
        for r in range(size):
            if n > k:  # equal cosines: the smaller position
                near_r = np.flatnonzero(score[r] >= score[r, near[r]].min())
            else:
                near_r = near[r]
            best = near_r[np.lexsort((near_r, -score[r, near_r]))[:k]]
            best = best[score[r, best] > 0]
            out.append((score[r, best], best))
        return out

    @staticmethod
    def _finish(score, wide, table, todo) -> None:
        """Adds the common features' part to the blocks of examples that ``todo`` names for each text."""
        for b in np.flatnonzero(todo.any(axis=0)).tolist():
            who, at = np.flatnonzero(todo[:, b]), slice(b * BLOCK, min((b + 1) * BLOCK, len(table)))
            score[who, at] += wide[who] @ table[at].T

    def share(self, cosine: np.ndarray, at: np.ndarray) -> float:
        """Cosine-weighted share of toxic votes, drawn to the share of toxic examples."""
        return (cosine @ self.labels[at] + PRIOR_VOTES * self.prior) / (cosine.sum() + PRIOR_VOTES)

    def calibrate(self, shares: np.ndarray, labels: np.ndarray, rounds: int = 50) -> None:
        """Fits the probability of the label to the shares of votes: a logistic curve in their log-odds."""
        x, y = logit(shares), labels
        w = np.array([0.0, 1.0])
        z = np.stack([np.ones_like(x), x])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-(w @ z)))
            grad = z @ (p - y) + 1e-3 * (w - [0.0, 1.0])
            w = w - np.linalg.solve((z * (p * (1 - p))) @ z.T + 1e-3 * np.eye(2), grad)
        self.shift, self.slope = float(w[0]), float(max(w[1], 1e-6))

    def score(self, texts: pa.Array, skip: np.ndarray | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """For every text its probability of the label, and its neighbours' cosines and positions."""
        if not len(self.labels):
            return [(0.0, np.zeros(0), np.zeros(0, dtype=np.int64))] * len(texts)
        found = self.nearest(texts, skip=skip)
        odds = self.shift + self.slope * logit(np.array([self.share(c, at) for c, at in found]))
        return [(p, *near) for p, near in zip((1 / (1 + np.exp(-odds))).tolist(), found, strict=True)]


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def lift(toxic: np.ndarray, held: np.ndarray, n1: int, n: int) -> np.ndarray:
    """G statistic of a feature that ``held`` of ``n`` examples have, ``toxic`` of the ``n1`` toxic ones among them."""

    def part(x, row, col):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log(x * n / (row * col)), 0.0)

    n0 = n - n1
    return np.maximum(0, 2 * (part(toxic, held, n1) + part(held - toxic, held, n0) + part(n1 - toxic, n - held, n1) + part(n0 - held + toxic, n - held, n0)))


def document_frequencies(corpus: DataFrame, names: list[str], text: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and how many texts there are: one pass over all of ``corpus``."""
    held = ship(corpus.sparkSession, {f: k for k, f in enumerate(names)})

    def run(batches):
        numbers = held()
        sums, rows = np.zeros(len(numbers) + 1, dtype=np.int64), 0
        for batch in text_batches(batches):
            rows += batch.num_rows
            sums[:-1] += np.bincount(feature_counts(batch.column(0), numbers)[1], minlength=len(numbers))
        sums[-1] = rows
        hit = np.flatnonzero(sums)
        for at in range(0, len(hit), 65_536):
            some = hit[at : at + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["feature", "n"])

    sums = corpus.select(text).where(F.col(text).isNotNull()).mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(names) + 1, dtype=np.int64)
    out[sums.column("feature").to_numpy()] = sums.column("n").to_numpy()
    return out[:-1], int(out[-1])


def fit(labelled: DataFrame, corpus: DataFrame | None = None) -> ExampleIndex:
    """Indexes labelled rows (``doc_id``, ``text``, ``toxic``), with document frequencies of ``corpus`` (by default the rows themselves).

    ``labelled`` is a bounded sample (``training_rows``); every row of it with a
    text and a label is indexed with all its features, equal texts once, with
    the label of the smallest id. A feature weighs its inverse document
    frequency in the whole corpus times 1 + the root of its G statistic against
    the labels: plain TF-IDF finds texts of like subject rather than of like
    tone. Scores are fitted to the examples' own votes, each without itself.
    Without any example every score is 0.
    """
    rows = labelled.where("text IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "text", (F.col("toxic") != 0).cast("int").alias("toxic"))
    rows = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.min(F.struct("doc_id", "toxic", "text")).alias("x")).select("h", "x.doc_id", "x.toxic", "x.text")
    use = cut(rows, "toxicity-sample")
    kind = use.schema["doc_id"].dataType.simpleString()

    def read():
        def step(batch):
            found = []
            for text in batch.column(3).to_pylist():
                counts: Counter = Counter()
                for token, n in Counter(pc.utf8_split_whitespace(pc.utf8_lower(pa.scalar(text))).as_py()).items():
                    counts.update(dict.fromkeys(word_features(token), n))
                found.append(counts)
            return [batch.column(0), batch.column(1), batch.column(2), [list(c) for c in found], [list(c.values()) for c in found]]

        return step

    got = map_arrow(use, read, f"h long, doc_id {kind}, toxic int, names array<string>, counts array<int>").orderBy("h").toArrow().combine_chunks()
    n = got.num_rows
    if not n:
        return ExampleIndex([], np.zeros(0), pa.array([]), np.zeros(0), np.zeros(0), np.zeros(0, int), np.zeros(0, int), np.zeros(0), 0.0)
    lists = pa.concat_arrays(got.column("names").chunks)
    coded = lists.flatten().dictionary_encode()
    names, cols = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy())
    counts, labels = pc.list_flatten(got.column("counts")).to_numpy(), got.column("toxic").to_numpy()
    n1, held = int(labels.sum()), np.bincount(cols, minlength=len(names))
    known, texts = (held, n) if corpus is None else document_frequencies(corpus, names)
    weights = np.log(1 + texts / np.maximum(1, known)) * (1 + np.sqrt(lift(np.bincount(cols, weights=labels[at], minlength=len(names)), held, n1, n)))
    index = ExampleIndex(names, weights, pa.concat_arrays(got.column("doc_id").chunks), got.column("h").to_numpy(), labels, at, cols, counts, (n1 + 0.5) / (n + 1))
    shared = ship(use.sparkSession, index)

    def vote():
        ix = shared()

        def step(batch):
            found = ix.nearest(batch.column(1), skip=np.array([ix.places[h] for h in batch.column(0).to_pylist()]))
            return [[ix.share(c, near) for c, near in found], batch.column(2)]

        return step

    own = map_arrow(use.select("h", "text", "toxic"), vote, "share double, toxic int").orderBy("share", "toxic").toArrow()
    index.calibrate(own.column("share").to_numpy(), own.column("toxic").to_numpy().astype(np.float64))
    return index


def score(docs: DataFrame, index: ExampleIndex, text: str = "text") -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` and ``evidence`` for every row.

    The score is the probability of the label for the text's votes: the
    cosine-weighted share of toxic labels among its NEIGHBOURS nearest examples,
    drawn to the share of toxic examples. A text that shares no feature with any
    example (an empty or null one, too) has no neighbour and the score of that
    share. ``evidence`` lists the nearest examples' ids, cosines and labels.
    Repeated rows give equal rows, other columns are ignored, and an empty table
    gives an empty result.
    """
    held = ship(docs.sparkSession, index)  # bounded by the rows of the sample
    kind, of = docs.schema["doc_id"].dataType.simpleString(), index.ids.type if len(index.ids) else pa.int64()
    ids = from_arrow_type(of).simpleString()

    def start():
        ix = held()

        def step(batch):
            got = ix.score(batch.column(1))
            ends = np.cumsum([0, *(len(at) for _, _, at in got)]).astype(np.int32)
            at = np.concatenate([a for _, _, a in got]) if got else np.zeros(0, dtype=np.int64)
            cosines = np.concatenate([c for _, c, _ in got]) if got else np.zeros(0)
            fields = [pa.field("doc_id", of), pa.field("cosine", pa.float64()), pa.field("toxic", pa.int32())]
            flat = pa.StructArray.from_arrays([ix.ids.take(pa.array(at)) if len(ix.ids) else pa.array([], of), pa.array(cosines), pa.array(ix.labels[at].astype(np.int32))], fields=fields)
            scores = [s for s, _, _ in got]
            return [batch.column(0), scores, [int(s >= 0.5) for s in scores], pa.ListArray.from_arrays(pa.array(ends), flat)]

        return step

    return map_arrow(docs.select("doc_id", text), start, f"doc_id {kind}, score double, predicted int, evidence array<struct<doc_id: {ids}, cosine: double, toxic: int>>")


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = 4_096, held_out: int = 0, folds: int = 5) -> DataFrame:
    """Labelled texts outside the held-out fold (crc32 of the id as text, modulo ``folds``).

    About ``rows`` labels spread by a hash of the id (all where there are fewer)
    are enough to fit on; that bound is also why they may be broadcast. An id
    with several labels counts as toxic if any is. Null ids are left out.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(id_crc32() % folds != held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(F.broadcast(spread_sample(known, "doc_id", rows)), "doc_id")


def keep_clean(docs: DataFrame, index: ExampleIndex) -> DataFrame:
    """The rows of ``docs`` whose whole text scores below 0.5, all columns as they were.

    Null and empty texts have no neighbour and stay unless most examples are
    toxic; repeated rows stay or go together; an empty table stays empty.
    """
    held = ship(docs.sparkSession, index)

    def run(batches):
        ix = held()
        for batch in text_batches(batches):
            at = batch.schema.get_field_index("text")
            yield batch.filter(pa.array([s < 0.5 for s, _, _ in ix.score(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
