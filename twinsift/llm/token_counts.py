"""Token counts by greedy longest match, in time linear in the text.

The vocabulary's pieces form a trie, one root for pieces that begin a word and one for pieces that go on.  Every
node knows where to go on when the next character has no edge (its failure link) and how many pieces are
complete by then, so a word's number of pieces comes out of one walk and no piece is ever built.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMO = 400_000  # words whose count a worker remembers; beyond it the memo starts anew


class Automaton:
    """Walks over latin-1 strings that stand for UTF-8 bytes, or over any characters the pieces are made of."""

    def __init__(self, first: Iterable[str], later: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]  # node 0: a word begins; node 1: it goes on
        whole = {self._insert(0, p) for p in first if p} | {self._insert(1, p) for p in later if p}
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                queue.append(v)
                if v in whole:
                    self.fail[v], self.popped[v] = 1, 1
                    continue
                z, n = self.fail[u], self.popped[u]
                while z >= 0 and c not in self.next[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.next[z][c], n

    def _insert(self, node: int, piece: str) -> int:
        for c in piece:
            after = self.next[node].get(c)
            if after is None:
                after = self.next[node][c] = len(self.next)
                self.next.append({})
            node = after
        return node

    def count(self, word: str) -> int:
        """Pieces of a word; 1 (the unknown piece) if the pieces do not cover it, 0 if it is empty."""
        nxt, fail, popped = self.next, self.fail, self.popped
        v, n = 0, 0
        for c in word:
            while c not in nxt[v]:
                n += popped[v]
                v = fail[v]
                if v < 0:
                    return 1
            v = nxt[v][c]
        while v > 1:
            n += popped[v]
            v = fail[v]
            if v < 0:
                return 1
        return n


def _byte_letters() -> dict[str, str]:
    """The printable letters by which byte-level vocabularies write bytes, and the latin-1 letter of each."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): chr(b) for b in plain} | {chr(256 + i): chr(b) for i, b in enumerate(rest)}


def byte_level_pieces(path: str) -> list[str]:
    """Pieces of a byte-level vocabulary file, as latin-1 strings; a leading space marks the start of a word."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    letters = _byte_letters()
    return ["".join(letters[c] for c in p) for p in vocab if all(c in letters for c in p)]


_AUTOMATA: dict[str, tuple[Automaton, dict[bytes, int]]] = {}


def _automaton(pieces) -> tuple[Automaton, dict[bytes, int]]:
    """One per worker process and vocabulary."""
    if pieces.id not in _AUTOMATA:
        found = pieces.value
        starts = [p for p in found if p.startswith(" ")]
        _AUTOMATA[pieces.id] = Automaton(starts, [p for p in found if not p.startswith(" ")]), {}
    return _AUTOMATA[pieces.id]


class _Pieces:
    """A broadcast with a digest of all its pieces in order, which tells vocabularies apart in a worker."""

    def __init__(self, spark: SparkSession, pieces: list[str]):
        self.broadcast = spark.sparkContext.broadcast(pieces)
        self.id = hashlib.sha256(json.dumps(pieces).encode()).hexdigest()

    @property
    def value(self) -> list[str]:
        return self.broadcast.value


def count_tokens(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """``doc_id, n_words, n_tokens`` for every row: pieces of each word, a word being written with a space before it.

    ``pieces`` (the vocabulary, of a fixed size) is broadcast.  A null or empty text has 0 words and tokens; texts of
    any length are walked whole; null ids and repeated rows are kept; an empty table gives an empty result;
    further columns are ignored.
    """
    vocabulary = _Pieces(docs.sparkSession, pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, memo = _automaton(vocabulary)
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = text.split() if text else []
                total = 0
                for w in words:
                    n = memo.get(w)
                    if n is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        n = memo[w] = automaton.count(" " + w.decode("latin-1"))
                    total += n
                n_words.append(len(words))
                n_tokens.append(total)
            yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "doc_id long, n_words long, n_tokens long")
