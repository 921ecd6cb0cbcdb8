"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words, the shapes of its words (case, digits and punctuation, runs shortened) and the repetition
of the word before.  Terms are hashed to a fixed number of columns, so none is left out.  A bounded sample of labelled
texts gives the columns' inverse document frequencies and, by randomised SVD of the weighted matrix, a latent space.
The sample's vectors and labels are broadcast; every text is projected and compared with all of them by blocked exact
cosine products, and its nearest neighbours vote with their similarity as weight.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.llm.texts import Words, by_bytes, words_of
from twinsift.llm.toxicity import labelled_texts, training_sample

SAMPLE = 4096  # labelled texts that vote, taken by hash
SHAPES, CONTENT = 4096, 4096  # columns of the shapes and of the words themselves
REPEAT = SHAPES + CONTENT  # the column of repetitions
COLUMNS = REPEAT + 1
CONTENT_WEIGHT = 0.25  # of a word against its shape: subjects differ among good texts, too
RANK = 32
NEIGHBOURS = 15
SHARPNESS = 8
BLOCK = 512  # texts whose products with all voters are held at a time
CUT = 0.3
LONGEST = 64  # characters of a word that are outlined at a time
MEMO = 300_000
_RUNS = re.compile(r"(.)\1+")
_WORDY = str.maketrans({c: "9" for c in "0123456789"})


def _outline(w: str) -> str:
    w = "".join("A" if c.isupper() else "a" if c.isalpha() else c for c in w.translate(_WORDY))
    return _RUNS.sub(r"\1", w)


def shapes(word: str) -> Counter:
    """``Word,`` -> ``Aa,``; ``SHOUT!!`` -> ``A!``; ``a1b2`` -> ``a9a9``: every eight letters of the outline a term.

    Outlines are drawn for ``LONGEST`` characters at a time, the whole of a word whatever its length.
    """
    pieces = (_outline(word[i : i + LONGEST]) for i in range(0, len(word), LONGEST))
    return Counter(w[i : i + 8] for w in pieces for i in range(0, len(w), 8))


def columns_of(word: str) -> tuple[tuple[int, int], ...]:
    """(column, how often) of a word's terms."""
    found = [(zlib.crc32(s.encode()) % SHAPES, n) for s, n in shapes(word).items()]
    return (*found, (SHAPES + zlib.crc32(word.lower().encode()) % CONTENT, 1))


@dataclass
class Terms:
    """Term counts of some texts: sorted by text, then column."""

    text: np.ndarray
    column: np.ndarray
    n: np.ndarray
    texts: int

    def part(self, first: int, last: int) -> Terms:
        a, b = np.searchsorted(self.text, [first, last])
        return Terms(self.text[a:b] - first, self.column[a:b], self.n[a:b], last - first)


def term_counts(words: Words, memo: dict[str, tuple[tuple[int, int], ...]]) -> Terms:
    known = []
    for w in words.distinct.to_pylist():
        found = memo.get(w)
        if found is None:
            if len(memo) >= MEMO:
                memo.clear()
            found = memo[w] = columns_of(w)
        known.append(found)
    many = np.array([len(k) for k in known], dtype=np.int64)
    flat = np.array([x for k in known for x in k], dtype=np.int64).reshape(-1, 2)
    text = words.text()
    pairs, n = np.unique(text.astype(np.int64) * max(1, len(known)) + words.codes, return_counts=True)
    of, word = np.divmod(pairs, max(1, len(known)))
    row = np.repeat(np.arange(len(word)), many[word])
    at = (np.cumsum(many) - many)[word[row]] + np.arange(len(row)) - (np.cumsum(many[word]) - many[word])[row]
    again = text[1:][(words.codes[1:] == words.codes[:-1]) & (text[1:] == text[:-1])]
    keys = np.r_[of[row] * COLUMNS + flat[at, 0], again.astype(np.int64) * COLUMNS + REPEAT]
    keys, back = np.unique(keys, return_inverse=True)
    counts = np.bincount(back, weights=np.r_[n[row] * flat[at, 1], np.ones(len(again))], minlength=len(keys))
    return Terms(keys // COLUMNS, keys % COLUMNS, counts, len(words.ends) - 1)


@dataclass
class Model:
    idf: np.ndarray | None = None  # by column, words less by CONTENT_WEIGHT
    basis: np.ndarray | None = None  # columns x rank
    voters: np.ndarray | None = None  # rank x voters, unit columns
    labels: np.ndarray | None = None
    prior: float = 0.5

    def weigh(self, t: Terms) -> np.ndarray:
        """Square roots of shares, times idf."""
        total = np.bincount(t.text, weights=np.where((t.column < SHAPES) | (t.column == REPEAT), t.n, 0.0), minlength=t.texts)
        return (np.sqrt(t.n / np.maximum(total, 1)[t.text]) * self.idf[t.column]).astype(np.float32)

    def project(self, t: Terms) -> np.ndarray:
        z = np.zeros((t.texts, self.basis.shape[1]), dtype=np.float32)
        if len(t.text):
            first = np.flatnonzero(np.r_[True, t.text[1:] != t.text[:-1]])
            z[t.text[first]] = np.add.reduceat(self.basis[t.column] * self.weigh(t)[:, None], first, axis=0)
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, t: Terms) -> np.ndarray:
        if self.voters is None:
            return np.full(t.texts, self.prior)
        out = np.empty(t.texts)
        for i in range(0, t.texts, BLOCK):
            z = self.project(t.part(i, min(i + BLOCK, t.texts)))
            cosine = z @ self.voters
            k = min(NEIGHBOURS, cosine.shape[1])
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0).astype(np.float64) ** SHARPNESS
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1)
            out[i : i + len(z)] = np.where(total > 1e-9, vote / np.maximum(total, 1e-9), self.prior)
        return out


def randomised_svd(a: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:
    """The right singular vectors of ``a`` (columns), by a random range and two power steps."""
    k = min(rank, *a.shape)
    y = a @ np.random.default_rng(seed).standard_normal((a.shape[1], min(k + 8, *a.shape))).astype(a.dtype)
    for _ in range(2):
        y, _ = np.linalg.qr(a @ (a.T @ y))
    q, _ = np.linalg.qr(y)
    return np.linalg.svd(q.T @ a, full_matrices=False)[2][:k].T


def fit_model(texts: list[tuple[tuple[int, ...], tuple[float, ...], int]]) -> Model:
    """From (columns, counts, label) of each sampled text; the order of the texts does not matter."""
    texts = sorted(t for t in texts if t[0])
    if not texts:
        return Model()
    size = [len(c) for c, _, _ in texts]
    t = Terms(np.repeat(np.arange(len(texts)), size), np.concatenate([np.array(c) for c, _, _ in texts]), np.concatenate([np.array(n) for _, n, _ in texts]), len(texts))
    labels = np.array([y for _, _, y in texts], dtype=np.float64)
    model = Model(prior=float(labels.mean()))
    weight = np.where((np.arange(COLUMNS) >= SHAPES) & (np.arange(COLUMNS) < REPEAT), CONTENT_WEIGHT, 1.0)
    model.idf = (np.log((1 + len(texts)) / (1 + np.bincount(t.column, minlength=COLUMNS))) + 1) * weight
    dense = np.zeros((len(texts), COLUMNS), dtype=np.float32)
    dense[t.text, t.column] = model.weigh(t)
    model.basis = randomised_svd(dense, RANK)
    model.voters, model.labels = np.ascontiguousarray(model.project(t).T), labels
    return model


def fit(docs: DataFrame, sample: DataFrame) -> Model:
    """Learn from the labelled texts of ``sample`` (doc_id, _label), a table of a documented size, in one task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for whole in batches:
            for batch in by_bytes(whole, 0):
                t = term_counts(words_of(batch.column(0)), memo)
                ends = pa.array(np.searchsorted(t.text, np.arange(t.texts + 1)).astype(np.int32))
                cols = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (t.column.astype(np.int32), t.n)]
                yield pa.record_batch([*cols, batch.column(1)], ["columns", "n", "label"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(tuple(c), tuple(n), int(y)) for b in batches for c, n, y in zip(*(b.column(i).to_pylist() for i in range(3)))]
        yield pa.record_batch([pa.array([pickle.dumps(fit_model(rows))])], ["model"])

    counted = labelled_texts(docs, sample).select("text", "_label").mapInArrow(count, "columns array<int>, n array<double>, label int")
    found = counted.repartition(1).mapInArrow(learn, "model binary").first()
    return pickle.loads(found["model"]) if found else Model()


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every whole text: the share of label 1 in its neighbours' weighted vote.

    A null, empty or blank text has no terms and gets the voters' share of label 1, as every text does if there is
    nothing to learn from.  Null ids and repeated rows are kept; an empty table gives an empty result; further
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memo = shared.value, {}
        for whole in batches:
            for batch in by_bytes(whole, 1):
                found = own.score(term_counts(words_of(batch.column(1)), memo))
                yield pa.record_batch([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def may_learn() -> Column:
    """Rows whose labels may be learnt from: crc32 of the id's text, modulo 5, is not 0."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 != 0


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels that may be learnt from and score all of ``docs``."""
    return score_documents(docs, fit(docs, training_sample(labels, may_learn(), "quality", SAMPLE)))
