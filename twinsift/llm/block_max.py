"""Ranked lexical search by block-max pruning.

The index is a table of blocks: ``BLOCK`` documents in the order in which they are read, each block with its own forward
index (per term of the queries: documents and whole-number impacts) and per-term maxima.  A query's bound for a block
is the sum of its weights times the maxima.  First every task names the blocks with the greatest bounds; scoring these
few gives each query a threshold that k documents reach.  Then every task takes its blocks in the order of a query's
bound and scores them until the bound drops below the threshold, which rises as better documents are found.  No
document is left out that could be among the k best: a block is skipped only if its bound is below k scores known,
and blocks at the threshold are scored, since ties go to the smaller id.

Queries are broadcast, ``QUERIES`` at a time: more of them take more passes.  Documents stay where they are read; only
the index goes to the shared checkpoint folder, and at most k rows a task and query are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsift.lineage import cut, written
from twinsift.llm.texts import Words, by_bytes, words_of

BEST = 10
BLOCK = 64  # documents
SEEDS = 2  # blocks by bound that give a query its first threshold
QUERIES = 20_000  # that are broadcast and looked up at a time
SLICE = 4 << 20  # bytes of blocks whose bounds are held at a time
# Fixed values of the scoring: impact = UNIT * tf div (1000 * tf + SPREAD * m), m = 100 - LENGTH + LENGTH * n * N div L.
UNIT, SPREAD, LENGTH = 1_000_000_000, 8, 90

#: What every byte becomes: letters small, digits and what is no ASCII as they are, all else a space.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], dtype=np.uint8)


def terms_of(texts: pa.Array) -> Words:
    """The terms of texts: runs of ASCII letters, digits and characters that are no ASCII, with A-Z lower-cased; null has none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int32)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    return words_of(pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).astype(np.int32).tobytes()), pa.py_buffer(_FOLD[data].tobytes())))


@dataclass
class Queries:
    """Distinct terms of each query, as places in a vocabulary, side by side."""

    numbers: list[int]
    vocabulary: pa.Array
    codes: np.ndarray
    ends: np.ndarray
    weights: np.ndarray | None = None  # of each of ``codes``
    thresholds: np.ndarray | None = None  # by query: a score that k documents reach, 1 if there are fewer

    def of(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.ends[q], self.ends[q + 1])
        return self.codes[part], self.weights[part]

    def bounds(self, codes: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Each query's bound for a block with these terms and maxima."""
        dense = np.zeros(len(self.vocabulary) + 1, dtype=np.int64)
        dense[codes] = most
        sums = np.r_[0, np.cumsum(self.weights * dense[self.codes])]
        return sums[self.ends[1:]] - sums[self.ends[:-1]]


@dataclass
class Block:
    ids: list
    terms: np.ndarray
    ends: np.ndarray  # of each term's documents
    docs: np.ndarray
    impacts: np.ndarray

    def scores(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, codes), max(0, len(self.terms) - 1))
        hit = self.terms[at] == codes
        at, weights = at[hit], weights[hit]
        many = self.ends[at + 1] - self.ends[at]
        entry = np.repeat(self.ends[at] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        found = np.zeros(len(self.ids), dtype=np.int64)
        np.add.at(found, self.docs[entry], np.repeat(weights, many) * self.impacts[entry])
        return found


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists side by side, and where each begins and the last ends."""
    ends = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], ends - ends[0]


def _lists(values: np.ndarray | pa.Array, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def forward_blocks(docs: DataFrame, vocabulary: pa.Array, id_col: str, text_col: str) -> DataFrame:
    """A row per block: ``ids``, ``sizes`` (all terms of each document), and per term of the vocabulary that occurs
    ``terms, many`` and side by side ``docs, tfs``."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for batch in by_bytes(whole, 1):
                words = terms_of(batch.column(1))
                code = pc.fill_null(pc.index_in(words.distinct, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[words.codes]
                doc = words.text()[code >= 0]
                code = code[code >= 0]
                block = doc // BLOCK
                key, tf = np.unique((block * (len(known) + 1) + code) * BLOCK + doc % BLOCK, return_counts=True)
                term, first = key // BLOCK, np.flatnonzero(np.r_[True, key[1:] // BLOCK != key[:-1] // BLOCK]) if len(key) else np.zeros(0, dtype=np.int64)
                blocks = -(-batch.num_rows // BLOCK)
                edge = np.arange(blocks + 1)
                rows = np.minimum(edge * BLOCK, batch.num_rows)
                of_term = np.searchsorted(term[first] // (len(known) + 1), edge)
                of_entry = np.searchsorted(term // (len(known) + 1), edge)
                yield pa.record_batch([
                    _lists(batch.column(0), rows), _lists(np.diff(words.ends).astype(np.int64), rows),
                    _lists((term[first] % (len(known) + 1)).astype(np.int32), of_term), _lists(np.diff(np.r_[first, len(key)]).astype(np.int32), of_term),
                    _lists((key % BLOCK).astype(np.int8), of_entry), _lists(tf.astype(np.int32), of_entry),
                ], ["ids", "sizes", "terms", "many", "docs", "tfs"])

    rows = docs.select(id_col, F.make_valid_utf8(F.col(text_col).cast("string")).alias(text_col))
    return rows.mapInArrow(run, f"ids array<{kind}>, sizes array<long>, terms array<int>, many array<int>, docs array<tinyint>, tfs array<int>")


def statistics(blocks: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and how many documents hold each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, total = np.zeros(terms, dtype=np.int64), 0, 0
        for batch in batches:
            sizes, code, many = (_flat(c)[0] for c in batch.columns)
            n, total = n + int((sizes > 0).sum()), total + int(sizes.sum())
            sums += np.bincount(code, weights=many, minlength=terms).astype(np.int64)
        at = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(np.r_[-2, -1, at].astype(np.int32)), pa.array(np.r_[n, total, sums[at]].astype(np.int64))], ["term", "n"])

    found = blocks.select("sizes", "terms", "many").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    every = dict(zip(found["term"], found["n"]))
    df = np.zeros(terms, dtype=np.int64)
    for t, n in every.items():
        if t >= 0:
            df[t] = n
    return int(every.get(-2, 0)), int(every.get(-1, 0)), df


def with_impacts(blocks: DataFrame, n: int, total: int) -> DataFrame:
    """The index: blocks with impacts in place of frequencies, and ``most``, the maximum of each of their terms."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rows = _flat(batch.column(1))
            many, per_block = _flat(batch.column(3))
            doc, entries = _flat(batch.column(4))
            tf = _flat(batch.column(5))[0].astype(np.int64)
            spread = 100 - LENGTH + LENGTH * size * n // total
            of = np.repeat(rows[:-1], np.diff(entries)) + doc
            impact = UNIT * tf // (1000 * tf + SPREAD * spread[of])
            first = np.cumsum(many) - many
            most = np.maximum.reduceat(impact, first) if len(first) else np.zeros(0, dtype=np.int64)
            yield pa.record_batch([
                batch.column(0), batch.column(2), batch.column(3), batch.column(4),
                _lists(impact.astype(np.int32), entries), _lists(most.astype(np.int32), per_block),
            ], ["ids", "terms", "many", "docs", "impacts", "most"])

    # A block without a term of any query can be no result.
    out = blocks.where("size(terms) > 0").mapInArrow(run, f"ids array<{kind}>, terms array<int>, many array<int>, docs array<tinyint>, impacts array<int>, most array<int>")
    return out.withColumn("block", F.monotonically_increasing_id())


def _best_blocks(index: DataFrame, queries: Queries) -> DataFrame:
    """``block``: the blocks with the greatest bounds of each query."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        bound, block = np.zeros((SEEDS, len(q.numbers)), dtype=np.int64), np.full((SEEDS, len(q.numbers)), -1, dtype=np.int64)
        for batch in batches:
            names = batch.column(0).to_numpy()
            (terms, ends), (most, _) = _flat(batch.column(1)), _flat(batch.column(2))
            for i, name in enumerate(names):
                part = slice(ends[i], ends[i + 1])
                new, at = q.bounds(terms[part], most[part]), np.full(len(q.numbers), name)
                for level in range(SEEDS):  # what is greater moves in, what it displaces moves down
                    up = new > bound[level]
                    bound[level], new = np.where(up, new, bound[level]), np.where(up, bound[level], new)
                    block[level], at = np.where(up, at, block[level]), np.where(up, block[level], at)
        real = np.nonzero(block >= 0)
        yield pa.record_batch([pa.array(real[1].astype(np.int32)), pa.array(block[real]), pa.array(bound[real])], ["query", "block", "bound"])

    rows = index.select("block", "terms", "most").mapInArrow(run, "query int, block long, bound long")
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block"))
    return rows.withColumn("_n", first).where(F.col("_n") <= SEEDS).select("block").distinct()


def _merge(best: list[tuple], new: list[tuple], k: int) -> list[tuple]:
    return sorted(best + new, key=lambda r: (-r[0], r[1] is None, r[1]))[:k]


def _score(index: DataFrame, queries: Queries, k: int) -> DataFrame:
    """``query, id, score``: of each task the k best documents of each query that reach its threshold."""
    kind = index.schema["ids"].dataType.elementType.simpleString()
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, best, id_type = shared.value, {}, None
        least = q.thresholds.copy()
        for whole in batches:
            id_type = whole.column(0).type.value_type
            for batch in _by_entries(whole):
                blocks, most = _open(batch)
                bounds = np.stack([q.bounds(b.terms, m) for b, m in zip(blocks, most)])
                for i in np.flatnonzero((bounds >= least).any(axis=0)):
                    codes, weights = q.of(i)
                    for j in np.argsort(-bounds[:, i], kind="stable"):
                        if bounds[j, i] < least[i]:
                            break
                        scores = blocks[j].scores(codes, weights)
                        at = np.flatnonzero(scores >= least[i])
                        if len(at):
                            best[i] = _merge(best.get(i, []), [(int(scores[d]), blocks[j].ids[d]) for d in at], k)
                            if len(best[i]) == k:
                                least[i] = max(least[i], best[i][-1][0])
        if id_type is not None:
            rows = [(i, d, s) for i, found in best.items() for s, d in found]
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), id_type, pa.int64()))], ["query", "id", "score"])

    return index.select("ids", "terms", "many", "docs", "impacts", "most").mapInArrow(run, f"query int, id {kind}, score long")


def _by_entries(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of blocks with about ``SLICE`` bytes of entries."""
    ends = np.cumsum(np.diff(batch.column(3).offsets.to_numpy()).astype(np.int64)) * 5
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SLICE, side="right")))
        yield batch.slice(first, last - first)
        first = last


def _open(batch: pa.RecordBatch) -> tuple[list[Block], list[np.ndarray]]:
    ids = batch.column(0).to_pylist()
    (terms, per_block), (many, _), (docs, entries), (impacts, _), (most, _) = (_flat(c) for c in batch.columns[1:])
    blocks = []
    for i, names in enumerate(ids):
        t, e = slice(per_block[i], per_block[i + 1]), slice(entries[i], entries[i + 1])
        blocks.append(Block(names, terms[t], np.r_[0, np.cumsum(many[t])], docs[e], impacts[e].astype(np.int64)))
    return blocks, [most[per_block[i] : per_block[i + 1]] for i in range(len(ids))]


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def _read_queries(items: DataFrame) -> Queries:
    """From ``number, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 1):
                words = terms_of(batch.column(1))
                key = np.unique(words.text() * (len(words.distinct) + 1) + words.codes)
                of, code = key // (len(words.distinct) + 1), key % (len(words.distinct) + 1)
                terms = words.distinct.cast(pa.string()).take(pa.array(code))
                yield pa.record_batch([batch.column(0), _lists(terms, np.searchsorted(of, np.arange(batch.num_rows + 1)))], ["number", "terms"])

    found = items.mapInArrow(run, "number long, terms array<string>").toArrow().combine_chunks().sort_by("number")
    lists = found["terms"].combine_chunks() if found.num_rows else pa.array([], pa.list_(pa.string()))
    terms = pc.dictionary_encode(lists.flatten())
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return Queries(found["number"].to_pylist(), terms.dictionary, terms.indices.to_numpy().astype(np.int64), np.r_[0, np.cumsum(lengths)].astype(np.int64))


def _search(docs: DataFrame, queries: Queries, k: int, id_col: str, text_col: str) -> DataFrame:
    """``query, id, score, rank`` by place of the query in ``queries``."""
    blocks, path = written(forward_blocks(docs, queries.vocabulary, id_col, text_col))
    n, total, df = statistics(blocks, len(queries.vocabulary))
    if not total:
        return docs.sparkSession.createDataFrame([], f"query int, id {docs.schema[id_col].dataType.simpleString()}, score long, rank int")
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
    queries = replace(queries, weights=weights[queries.codes], thresholds=np.ones(len(queries.numbers), dtype=np.int64))
    index, _ = written(with_impacts(blocks, n, total), path)
    seeds = index.join(F.broadcast(_best_blocks(index, queries)), "block", "left_semi")  # at most SEEDS blocks a query
    known = _top(_score(seeds, queries, k), k).where(F.col("rank") == k).select("query", "score").collect()
    for r in known:
        queries.thresholds[r["query"]] = r["score"]
    return cut(_top(_score(index, queries, k), k))


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents with the highest scores above 0 for each row of ``items``.

    Equal scores are ranked by ascending id, null ids last.  A null or empty text has no terms: such an item finds
    nothing, such a document is no result and does not count.  Repeated documents are ranked each, repeated items
    searched each under their id.  Without documents or items the result is empty; other columns are ignored.
    """
    kinds = {c: s.schema[c].dataType.simpleString() for s, c in ((docs, id_col), (items, item_col))}
    asked = cut(items.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text")).withColumn("number", F.monotonically_increasing_id()))
    parts = max(1, -(-asked.count() // QUERIES))
    out: Any = docs.sparkSession.createDataFrame([], f"`{item_col}` {kinds[item_col]}, rank int, `{id_col}` {kinds[id_col]}, score long")
    for part in range(parts):
        mine = asked.where(F.pmod(F.xxhash64("number"), F.lit(parts)) == part)
        queries = _read_queries(mine.select("number", F.make_valid_utf8("text").alias("text")))
        if not len(queries.vocabulary):
            continue
        numbers = docs.sparkSession.createDataFrame([(i, n) for i, n in enumerate(queries.numbers)], "query int, number long")
        names = numbers.join(mine.select("number", "item"), "number").select("query", F.col("item").alias(item_col))
        found = _search(docs, queries, k, id_col, text_col).join(F.broadcast(names), "query")
        out = out.unionByName(found.select(item_col, "rank", F.col("id").alias(id_col), "score"))
    return out
