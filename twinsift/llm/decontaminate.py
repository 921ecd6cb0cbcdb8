"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into overlapping passages and weighted by TF-IDF over the benchmark's vocabulary, with document
frequencies counted over the whole corpus.  A distributed randomised SVD of the passages gives the corpus's
latent directions: tasks multiply their passages with a random test matrix and back, and only that sketch
(columns x rank) is added up.  Passages and items are folded into that space, each direction damped by a power of its singular value.

Candidates are the passages whose cosine with an item's passage in the latent space reaches the item's level and that
hold enough of the item's length there.  The level is ``COSINE``, or less for an item so made of everyday words that
the words around a copy of it would outweigh it.  Around each candidate the longest common subsequence
with the whole item, the share of its weight that is present and the item's end (its answer) decide, which catches
copies with changed, missing or inserted words, and, where the cosine is high, paraphrases by other words of like meaning.

All items share one vocabulary, one encoded table of texts and one latent space; they are compared in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.lineage import cut, written
from twinsift.llm.texts import packed

WIDTH, STRIDE = 32, 16  # words of a passage
POWER_STEPS = 2
RANK = 128  # latent directions taken from the corpus
COLUMNS = 1 << 15  # of the weighted matrix: words beyond share columns, which bounds the driver's work; checks are on words
DAMPING = 0.75  # power of its singular value by which a direction is divided: 1 makes all alike, 0 leaves the commonest to rule
COSINE = 0.5  # in the latent space, from which a passage is a candidate
SLACK, OVERLAP = 0.4, 0.75  # of the cosine expected of a copy in the corpus's mean surroundings; share of a copy in its best passage
INSIDE = 0.5  # share of an item's length in the latent space that a candidate has in its direction
LCS, LCS_ALONE, WEIGHT, ANSWER = 0.6, 0.8, 0.5, 0.5
PARAPHRASE, LCS_PARAPHRASE, ANSWER_PARAPHRASE = 0.7, 0.5, 0.75  # from that cosine on, so short a common subsequence will do if so much of the answer is there
SHORT = 8  # items of fewer words must occur whole, word after word
ITEMS_AT_ONCE = 1000
MOST_ITEMS = 200_000
PRODUCTS = 2_000_000  # cosines that are held at a time
SLOTS, BITS = 1 << 12, 64  # of an item's table of places by word
AROUND = 2_000_000  # words around candidates that are looked up at a time
CHUNK_WORDS = 500_000
TEXTS_AT_ONCE = 500  # texts whose words are split at a time
PART = 256  # columns of the sketch that travel together
SALTS = 64  # reducers that share a part of the sketch at first
BROADCAST_KEYS = 1_000_000  # hashes of texts to drop; more are joined by shuffle
OTHER = -1
OUTER = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…¡¿–—"  # stripped from both ends of a word


def split_words(texts: pa.Array) -> pa.ListArray:
    """Words of each text, in lower case and without outer punctuation; words of nothing else are left empty."""
    found = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    return pa.ListArray.from_arrays(found.offsets, pc.utf8_trim(found.values, characters=OUTER), mask=found.is_null() if found.null_count else None)


def item_words(texts: list[str | None]) -> list[list[str]]:
    return [[w for w in words or () if w] for words in split_words(pa.array(texts, pa.string())).to_pylist()]


@dataclass
class Benchmark:
    """Items as word ids over their own vocabulary."""

    ids: list[int]
    items: list[np.ndarray]
    vocabulary: dict[str, int]
    weight: np.ndarray | None = None  # idf by word, at least 1: a leak may lie in any share of the documents
    other: float = 1.0  # weight of words outside the vocabulary
    basis: np.ndarray | None = None  # columns x rank, directions damped
    passages: np.ndarray | None = None  # unit vectors of the items' passages in the basis
    length: np.ndarray | None = None  # their lengths before
    level: np.ndarray | None = None  # cosine from which a passage is a candidate, by item passage; ``COSINE`` if not given
    item_of: np.ndarray | None = None

    def block(self, first: int, last: int) -> Benchmark:
        """The items from ``first`` to ``last`` over the same vocabulary and space."""
        a, b = np.searchsorted(self.item_of, [first, last])
        part = lambda x: None if x is None else x[a:b]
        return replace(self, ids=self.ids[first:last], items=self.items[first:last], passages=part(self.passages), length=part(self.length), level=part(self.level), item_of=self.item_of[a:b] - first)


def encode(docs: DataFrame, b: Benchmark) -> tuple[DataFrame, str]:
    """``doc_id, key, words`` of every row, and where that table lies: word ids as packed bytes, worked out once.

    ``key`` is a hash of the text; words outside the benchmark's vocabulary are all ``OTHER``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(list(b.vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                words = split_words(part.column(2))
                ids = pc.fill_null(pc.index_in(words.values, value_set=known), OTHER).to_numpy().astype(np.int32)
                real = pc.not_equal(pc.binary_length(words.values), 0).to_numpy(zero_copy_only=False)
                ends = np.r_[0, np.cumsum(real)][words.offsets.to_numpy()].astype(np.int32) * 4
                packed = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids[real].tobytes())])
                yield pa.record_batch([part.column(0), part.column(1), packed], ["doc_id", "key", "words"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), F.make_valid_utf8(F.col("text").cast("string")))
    return written(rows.mapInArrow(run, "doc_id long, key long, words binary"))


def chunks(packed: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts: number of the first, all their word ids, and where each text begins and the last ends."""
    ends = np.frombuffer(packed.buffers()[1], dtype=np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64) // 4
    words = np.frombuffer(packed.buffers()[2], dtype=np.int32) if packed.buffers()[2] is not None else np.zeros(0, dtype=np.int32)
    first = 0
    while first < len(packed):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK_WORDS, side="right")) - 1)
        yield first, words[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def windows(ends: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and end of every passage."""
    n = np.diff(ends)
    many = np.where(n > 0, 1 + np.maximum(0, -(-(n - WIDTH) // stride)), 0)
    text = np.repeat(np.arange(len(n)), many)
    start = ends[:-1][text] + stride * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
    return text, start, np.minimum(start + WIDTH, ends[1:][text])


def _padded(b: Benchmark, ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column and weight of every place of the passages; places without a word of the vocabulary weigh 0."""
    at = start[:, None] + np.arange(WIDTH)
    word = ids[np.minimum(at, max(0, len(ids) - 1))]
    known = (at < end[:, None]) & (word >= 0)
    return np.where(known, word % COLUMNS, 0), np.where(known, b.weight[np.maximum(word, 0)], 0.0).astype(np.float32)


def _products(weight: np.ndarray, rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Weighted sums of rows of a table, ``GATHERED`` sums at a time, which a cache can hold."""
    out = np.empty((len(rows), table.shape[1]), dtype=np.float32)
    for i in range(0, len(rows), GATHERED):
        out[i : i + GATHERED] = np.matmul(weight[i : i + GATHERED, None, :], table[rows[i : i + GATHERED]])[:, 0]
    return out


def _rows(b: Benchmark, ids: np.ndarray, start: np.ndarray, end: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """TF-IDF rows of the passages times ``basis``."""
    column, weight = _padded(b, ids, start, end)
    return _products(weight, column, basis.astype(np.float32, copy=False))


def _turned(column: np.ndarray, weight: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns that occur in padded passages, and for each the weighted sum of the rows ``z`` of the passages it occurs in."""
    row, place = np.nonzero(weight)
    of, w = column[row, place], weight[row, place]
    order = np.argsort(of.astype(np.uint16), kind="stable")
    of, w, row = of[order], w[order], row[order]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, dtype=np.int64)
    many = np.diff(np.r_[first, len(of)])
    runs = -(-many // RUN)  # each column's passages in runs of RUN, the last one filled up with weight 0
    begin = np.cumsum(runs) - runs
    at = np.repeat(begin * RUN - first, many) + np.arange(len(of))
    rows, weights = np.zeros(int(runs.sum()) * RUN, dtype=np.int64), np.zeros(int(runs.sum()) * RUN, dtype=np.float32)
    rows[at], weights[at] = row, w
    if not len(of):
        return of, np.zeros((0, z.shape[1]), dtype=np.float32)
    return of[first], np.add.reduceat(_products(weights.reshape(-1, RUN), rows.reshape(-1, RUN), z), begin, axis=0)


PIECE, GATHERED, RUN = 8192, 256, 16  # passages whose rows are held at a time; sums that are worked out at a time; places of a column in a run


def _passing(b: Benchmark, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The passages that shape the space, side by side: text, first word, end and a bound on the row's length."""
    text, start, end = windows(ends, WIDTH)
    sums = np.r_[0.0, np.cumsum(np.where(ids >= 0, b.weight[np.maximum(ids, 0)] ** 2, 0.0))]
    own = sums[end] - sums[start]
    keep = np.flatnonzero(own > 0)
    for i in range(0, len(keep), PIECE):
        k = keep[i : i + PIECE]
        yield text[k], start[k], end[k], np.sqrt(own[k])


def document_frequencies(encoded: DataFrame, b: Benchmark) -> tuple[np.ndarray, int]:
    """In how many documents each word of the vocabulary occurs, and how many documents there are."""
    size = len(b.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(size, dtype=np.int64), 0
        for batch in batches:
            for _, ids, ends in chunks(batch.column(0)):
                texts = len(ends) - 1
                text = np.repeat(np.arange(texts), np.diff(ends))
                keys = np.sort(ids[ids >= 0].astype(np.int64) * texts + text[ids >= 0])
                sums += np.bincount(keys[np.r_[True, keys[1:] != keys[:-1]]] // texts if len(keys) else keys, minlength=size)
            n += batch.num_rows
        at = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(np.r_[at, -1]), pa.array(np.r_[sums[at], n])], ["word", "n"])

    got = encoded.select("words").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    word, n = got["word"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(size, dtype=np.int64)
    df[word[word >= 0]] = n[word >= 0]
    return df, int(n[word < 0].sum())


def _summed(parts: DataFrame, k: int) -> dict[int, np.ndarray]:
    """Sums the pieces of a sketch (part, salt, y) in two steps, so that no reducer takes a piece of every task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, y in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(y, dtype=np.float32).astype(np.float64)
        salt = TaskContext.get().partitionId() % SALTS
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([salt] * len(sums), pa.int32()), pa.array([y.astype(np.float32).tobytes() for y in sums.values()], pa.binary())], ["part", "salt", "y"])

    schema = "part int, salt int, y binary"
    got = parts.repartition("part", "salt").mapInArrow(add, schema).repartition("part").mapInArrow(add, schema).select("part", "y").toArrow()
    return {p: np.frombuffer(y, dtype=np.float32).reshape(-1, k) for p, y in zip(got["part"].to_pylist(), got["y"].to_pylist())}


def normal_product(encoded: DataFrame, b: Benchmark, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A'(A test) for the passages A of unit length, and test'R'R test per passage for them at their own length R.

    Tasks multiply their own passages, and only columns x rank are added up.
    """
    size, k = test.shape
    shared = encoded.sparkSession.sparkContext.broadcast((replace(b, items=[], ids=[]), test.astype(np.float32)))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, o = shared.value
        y, around, n = np.zeros((size, k), dtype=np.float64), np.zeros((k, k)), 0
        for batch in batches:
            for _, ids, ends in chunks(batch.column(0)):
                for _, start, end, norm in _passing(own, ids, ends):
                    column, weight = _padded(own, ids, start, end)
                    z = _products(weight, column, o)
                    around += z.T @ z
                    n += len(z)
                    z /= (norm**2)[:, None].astype(np.float32)  # rows of unit length, twice
                    at, sums = _turned(column, weight, z)
                    y[at] += sums
        if n:
            parts = [*(y[i : i + PART] for i in range(0, size, PART)), np.concatenate([around, np.full((1, k), n)])]
            numbers = [*range(len(parts) - 1), -1]
            salt = TaskContext.get().partitionId() % SALTS
            yield pa.record_batch([pa.array(numbers, pa.int32()), pa.array([salt] * len(parts), pa.int32()), pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())], ["part", "salt", "y"])

    parts = _summed(encoded.select("words").mapInArrow(sketch, "part int, salt int, y binary"), k)
    if not parts:
        return np.zeros((size, k)), np.zeros((k, k))
    own = parts.pop(-1).astype(np.float64)
    return np.concatenate([parts[p] for p in sorted(parts)]).astype(np.float64), own[:k] / own[k, 0]


def latent_space(encoded: DataFrame, b: Benchmark, rank: int = RANK) -> tuple[np.ndarray, np.ndarray, float]:
    """Right singular vectors (columns x rank) of all passages' TF-IDF rows by a randomised SVD, their singular values, and
    the mean square of a passage's length when folded in.

    One pass over the passages takes a random matrix into their range, each further pass (a power step) sharpens the
    range, and the last gives the small matrix whose eigenvectors turn it into singular directions.
    """
    size = min(len(b.vocabulary), COLUMNS)
    q = np.random.default_rng(11).standard_normal((size, min(rank + 8, size)))
    for _ in range(POWER_STEPS):
        q, _ = np.linalg.qr(normal_product(encoded, b, q)[0])
    product, around = normal_product(encoded, b, q)
    core = q.T @ product
    vals, vecs = np.linalg.eigh((core + core.T) / 2)
    order = np.argsort(-vals)[:rank]
    order = order[vals[order] > 1e-6 * max(vals.max(), 1e-12)]
    turned = vecs[:, order]
    mean = float((np.diag(turned.T @ around @ turned) / vals[order] ** DAMPING).sum())
    return q @ turned, np.sqrt(vals[order]), mean


def latent_directions(encoded: DataFrame, b: Benchmark, rank: int = RANK) -> np.ndarray:
    return latent_space(encoded, b, rank)[0]


def prepare(docs: DataFrame, ids: list[int], texts: list[str | None]) -> tuple[Benchmark, DataFrame] | None:
    """Weights, latent space and item passages of all items, and the texts as ids of their vocabulary."""
    words = [(i, w) for i, w in zip(ids, item_words(texts)) if w]
    if not words:
        return None
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in words for w in ws}))}
    b = Benchmark([i for i, _ in words], [np.array([vocabulary[w] for w in ws], dtype=np.int32) for _, ws in words], vocabulary)
    encoded, _ = encode(docs, b)
    df, n = document_frequencies(encoded, b)
    idf = np.log((1 + n) / (1 + df))
    b.weight = 1 + idf
    vectors, values, mean = latent_space(encoded, b, RANK)
    b.basis = (vectors / values**DAMPING).astype(np.float32)
    flat, ends = np.concatenate(b.items), np.r_[0, np.cumsum([len(x) for x in b.items])]
    b.item_of, start, end = windows(ends)
    z = _rows(b, flat, start, end, b.basis)
    b.length = np.maximum(np.linalg.norm(z, axis=1), 1e-12)
    b.passages = z / b.length[:, None]
    # A copy at its worst place fills OVERLAP of its best passage, among words of the corpus's mean length.
    part = OVERLAP * b.length
    around = mean * (1 - OVERLAP * (end - start) / WIDTH)
    b.level = np.minimum(COSINE, SLACK * part / np.sqrt(part**2 + around))
    return b, encoded


def lcs_length(where: dict[int, int], n: int, words: list[int]) -> int:
    """Longest common subsequence, bit-parallel; ``where`` has the bits of each word's places in an item of n words."""
    full = (1 << n) - 1
    v = full
    for w in words:
        if m := where.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def holds(words: list[int], item: list[int]) -> bool:
    """Whether the item's words stand one after another among the words."""
    n, at = len(item), -1
    while True:
        try:
            at = words.index(item[0], at + 1, max(0, len(words) - n + 1))
        except ValueError:
            return False
        if words[at : at + n] == item:
            return True


def _places(item: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        out[w] = out.get(w, 0) | 1 << k
    return out


class Judge:
    """Finds and verifies the candidates of a run of texts for a block of items."""

    def __init__(self, b: Benchmark):
        self.b = b
        self.places = [_places(x) for x in b.items]
        self.tails = [x[-max(3, math.ceil(len(x) / 4)) :] for x in b.items]
        self.tail_places = [_places(x) for x in self.tails]
        self.weights = [b.weight[x].sum() for x in b.items]
        self.size = np.array([len(x) for x in b.items])
        # Bits of the places of each item at which a word (by slot) stands; long items have several places to a bit.
        self.fold = -(-self.size // BITS)
        self.bits = np.zeros((len(b.items), SLOTS), dtype=np.uint64)
        for k, x in enumerate(b.items):
            np.bitwise_or.at(self.bits[k], x % SLOTS, np.uint64(1) << (np.arange(len(x)) // self.fold[k]).astype(np.uint64))
        self.level = np.full(len(b.passages), COSINE) if b.level is None else b.level
        self.step = max(32, min(PIECE, PRODUCTS // max(1, len(self.level))))

    def candidates(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Text, item, first word and cosine of the passages near an item in the latent space."""
        b = self.b
        text, start, end = windows(ends)
        for i in range(0, len(text), self.step):
            z = _rows(b, ids, start[i : i + self.step], end[i : i + self.step], b.basis)
            length = np.linalg.norm(z, axis=1)
            cosine = (z / np.maximum(length, 1e-12)[:, None]) @ b.passages.T
            row, passage = np.nonzero(cosine >= self.level.astype(np.float32))
            near = cosine[row, passage]
            if b.length is not None:
                inside = near * length[row] >= INSIDE * b.length[passage]
                row, passage, near = row[inside], passage[inside], near[inside]
            by = np.lexsort((-near, b.item_of[passage], row))
            row, item, near = row[by], b.item_of[passage[by]], near[by]
            best = np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])] if len(row) else np.zeros(0, dtype=bool)
            at = i + row[best]
            kept = self.enough(ids, ends, text[at], item[best], start[at], near[best])
            yield text[at[kept]], item[best][kept], start[at[kept]], near[best][kept]

    def around(self, ends: np.ndarray, text: np.ndarray, item: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the words that a candidate is checked in: its passage and an item's length on either side."""
        return np.maximum(ends[text], start - self.size[item]), np.minimum(ends[text + 1], start + WIDTH + self.size[item])

    def enough(self, ids: np.ndarray, ends: np.ndarray, text: np.ndarray, item: np.ndarray, start: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Candidates around which words of so many places of the item occur that its common subsequence can be long enough."""
        low, high = self.around(ends, text, item, start)
        least = np.where(self.size[item] < SHORT, 1.0, np.where(near >= PARAPHRASE, LCS_PARAPHRASE, LCS)) * self.size[item] / self.fold[item] - 1e-9
        kept, first = np.zeros(len(text), dtype=bool), 0
        total = np.cumsum(high - low)
        while first < len(text):
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + AROUND, side="right")))
            length = (high - low)[first:last]
            begin = np.cumsum(length) - length
            word = ids[np.repeat(low[first:last] - begin, length) + np.arange(int(length.sum()))]
            bits = np.where(word >= 0, self.bits[np.repeat(item[first:last], length), word % SLOTS], np.uint64(0))
            kept[first:last] = np.bitwise_count(np.bitwise_or.reduceat(bits, begin)) >= least[first:last]
            first = last
        return np.flatnonzero(kept)

    def found(self, packed: pa.Array) -> Iterator[tuple[int, int, float, float, float, int]]:
        """Text, item, cosine, LCS share, answer share and first word of the passage, the best of each text and item."""
        for first, ids, ends in chunks(packed):
            best: dict[tuple[int, int], tuple[float, float, float, int]] = {}
            for texts, items, starts, cosines in self.candidates(ids, ends):
                low, high = self.around(ends, texts, items, starts)
                for text, item, start, cosine, lo, hi in zip(*(x.tolist() for x in (texts, items, starts, cosines, low, high))):
                    got = self.verify(item, ids[lo:hi].tolist(), cosine)
                    if got and ((text, item) not in best or (got[0], cosine) > (best[text, item][1], best[text, item][0])):
                        best[text, item] = (cosine, *got, start - int(ends[text]))
            for (text, item), of in sorted(best.items()):
                yield (first + text, item, *of)

    def verify(self, item: int, words: list[int], cosine: float = 0.0) -> tuple[float, float] | None:
        """LCS share and answer share if the words hold the item."""
        n = len(self.b.items[item])
        if n < SHORT:
            return (1.0, 1.0) if holds(words, self.b.items[item].tolist()) else None
        share = lcs_length(self.places[item], n, words) / n
        paraphrase = cosine >= PARAPHRASE and share >= LCS_PARAPHRASE
        if share < LCS and not paraphrase:
            return None
        answer = lcs_length(self.tail_places[item], len(self.tails[item]), words) / len(self.tails[item])
        if paraphrase and answer >= ANSWER_PARAPHRASE:
            return share, answer
        if share < LCS:
            return None
        present = set(words)
        weight = sum(self.b.weight[w] for w in self.b.items[item].tolist() if w in present)
        if weight < WEIGHT * self.weights[item]:
            return None
        return (share, answer) if share >= LCS_ALONE or answer >= ANSWER else None


def _items(benchmark: DataFrame) -> tuple[list[int], list[str | None]]:
    rows = benchmark.select(F.col("item_id").cast("long"), F.make_valid_utf8(F.col("text").cast("string")).alias("text")).orderBy("item_id", "text").limit(MOST_ITEMS + 1).collect()
    if len(rows) > MOST_ITEMS:
        raise ValueError(f"a benchmark of over {MOST_ITEMS} items is not held in memory: split it")
    return [r[0] for r in rows], [r[1] for r in rows]


FOUND = "doc_id long, item_id long, cosine double, lcs double, answer double, first_word long, key long"


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, cosine, lcs, answer, first_word, key``: one row per document row and item found in it."""
    spark = docs.sparkSession
    prepared = prepare(docs, *_items(benchmark))
    if prepared is None:
        return spark.createDataFrame([], FOUND)
    whole, encoded = prepared
    out: DataFrame | None = None
    for first in range(0, len(whole.ids), ITEMS_AT_ONCE):
        shared = spark.sparkContext.broadcast(whole.block(first, first + ITEMS_AT_ONCE))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            judge = Judge(shared.value)
            for batch in batches:
                got = list(judge.found(batch.column(2)))
                cols = list(zip(*got)) if got else [()] * 6
                at = pa.array(cols[0], pa.int64())
                yield pa.record_batch(
                    [batch.column(0).take(at), pa.array([judge.b.ids[i] for i in cols[1]], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[2:5]],
                     pa.array(cols[5], pa.int64()), batch.column(1).take(at)],
                    ["doc_id", "item_id", "cosine", "lcs", "answer", "first_word", "key"],
                )

        found = encoded.mapInArrow(run, FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, cosine, lcs, answer, first_word``: one row per document row and benchmark item found in it.

    Null, empty and wordless texts or items match nothing; null doc_ids are kept; repeated documents each have their
    rows, repeated items (or equal texts under several ids) each match; texts are searched whole; empty tables give
    an empty result; further columns are ignored.
    """
    return search(docs, benchmark).drop("key")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those in which a benchmark item is found, columns as they were.

    The verdict is on the text, so rows are told apart by their text's hash; rows with null texts stay.
    """
    bad = cut(search(docs, benchmark).select("key").distinct())
    small = bad.count() <= BROADCAST_KEYS
    keyed = packed(docs, of=F.xxhash64("text"))
    return keyed.join(F.broadcast(bad) if small else bad, F.col("of") == F.col("key"), "left_anti").select("row.*")
