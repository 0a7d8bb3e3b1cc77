"""Token counts by a linear longest-match automaton."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import map_arrow

#: Stands before every word, as in the vocabulary.
START = "▁"


class Automaton:
    """Greedy longest-match pieces of a word, counted without building them.

    A trie over the vocabulary. A node that is a piece fails to the root and
    pops that one piece. Another node fails to where its parent's failures can
    read its last character, and pops what those failures popped. Every
    character is read once and every failure shortens what is held, so a word
    takes time linear in its length. A character that the vocabulary lacks
    counts as its UTF-8 bytes.
    """

    def __init__(self, pieces: list[str]):
        whole = set(pieces)
        cost = {p: 1 for p in whole}
        for c in {c for p in whole for c in p} - whole:
            cost[c] = len(c.encode("utf-8", "surrogatepass"))
        self.go: list[dict[str, int]] = [{}]
        ends, order = {}, []
        for p in sorted(cost, key=len):
            at = 0
            for c in p:
                if c not in self.go[at]:
                    self.go[at][c] = len(self.go)
                    self.go.append({})
                at = self.go[at][c]
            ends[at] = cost[p]
        self.fail, self.pops = [-1] * len(self.go), [0] * len(self.go)
        order = [0]
        for u in order:
            for c, v in self.go[u].items():
                order.append(v)
                if v in ends:
                    self.fail[v], self.pops[v] = 0, ends[v]
                    continue
                z, n = self.fail[u], self.pops[u]
                while z >= 0 and c not in self.go[z]:
                    n += self.pops[z]
                    z = self.fail[z]
                # z reads c: every single character of the vocabulary is a node below the root
                self.fail[v], self.pops[v] = self.go[z][c], n

    def count(self, word: str) -> int:
        go, fail, pops, at, n = self.go, self.fail, self.pops, 0, 0
        for c in word:
            while c not in go[at]:
                if not at:
                    n += len(c.encode("utf-8", "surrogatepass"))
                    break
                n += pops[at]
                at = fail[at]
            else:
                at = go[at][c]
        while at:
            n += pops[at]
            at = fail[at]
        return n


def vocabulary(path: str | None = None) -> list[str]:
    """The pieces of a sentencepiece model, without its control and byte pieces."""
    import public_tokenizers
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]


def token_counts(docs: DataFrame, text: str = "text", path: str | None = None, held: int = 400_000) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_tokens`` and ``most_in_word`` of every whole text.

    Words are runs without white space; each is read behind the start mark. A
    null or blank text has no words and no tokens. Repeated rows give equal rows,
    rows with null ids theirs, other columns are ignored, and an empty table
    gives an empty result. Counts of words seen before come from memory (``held`` words at most, none over 64 characters).
    """

    def start():
        automaton, known = Automaton(vocabulary(path)), {}

        def of(word):
            n = known.get(word)
            if n is None:
                n = automaton.count(START + word)
                if len(word) <= 64:
                    if len(known) >= held:
                        known.clear()
                    known[word] = n
            return n

        def step(batch):
            words = [(t or "").split() for t in batch.column(1).to_pylist()]
            counts = [[of(w) for w in ws] for ws in words]
            return [batch.column(0), [len(c) for c in counts], [sum(c) for c in counts], [max(c, default=0) for c in counts]]

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", F.col(text)), start, f"doc_id {kind}, n_words long, n_tokens long, most_in_word long")
