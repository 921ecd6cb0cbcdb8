"""TF-IDF bags of items, each made whole in one row: features are looked up where their item lies and never shuffled.

Items are dealt into parts of some ``PART`` characters.  Every part sends a hash of each of its different features and how many
of its items have it, once; what comes back are the frequencies of those that more than one item of all has.  Features that
a part is told nothing of occur in one item.  Features are told apart by 64 bits of hash: among 100 million different ones,
two share a hash with a chance of 1 in 3,700.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.config import Mode
from twinsift.functions.hashing import hash31
from twinsift.lineage import written
from twinsift.operators import features
from twinsift.operators.wmh import P, pieces

PART = 4 << 20  # characters of items that share a table of frequencies
BUCKET = 8 << 20  # characters of items whose hashes are counted at a time


def _lists(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.ListArray]]:
    """The different values of ``key``, and for each the list of its rows of every column."""
    order = np.argsort(key, kind="stable")
    found, begins = np.unique(key[order], return_index=True)
    ends = pa.array(np.append(begins, len(key)).astype(np.int32))
    return found, [pa.ListArray.from_arrays(ends, pa.array(c[order])) for c in columns]


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows whose first column are numbers that lie one after the other, by that number."""
    number, held = None, []
    for batch in filter(len, batches):
        numbers = batch.column(0).to_numpy()
        begins = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1), len(numbers)]
        for a, b in zip(begins, begins[1:]):
            if numbers[a] != number:
                if held:
                    yield number, held
                number, held = numbers[a], []
            held.append(batch.slice(a, b - a))
    if held:
        yield number, held


def _counts_of_parts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """``bucket, part, hs, ns`` from rows of (part, hs) whose parts lie one after the other: a part's different hashes, dealt by their value."""
    for part, held in _runs_of(batches):
        h, n = np.unique(np.concatenate([b.column(1).flatten().to_numpy() for b in held]), return_counts=True)
        found, lists = _lists((h.view(np.uint64) % np.uint64(buckets)).astype(np.int64), h, n.astype(np.int64))
        yield pa.record_batch([pa.array(found), pa.array(np.full(len(found), part, dtype=np.int64)), *lists], ["bucket", "part", "hs", "ns"])


def _told_of_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``part, told, dfs``: the hashes of a part that more than one item of all has, from rows of ``_counts_of_parts`` by bucket."""
    for _, held in _runs_of(batches):
        h, n = (np.concatenate([b.column(i).flatten().to_numpy() for b in held]) for i in (2, 3))
        part = np.concatenate([np.repeat(b.column(1).to_numpy(), np.diff(b.column(2).offsets.to_numpy())) for b in held])
        order = np.argsort(h)
        h, part = h[order], part[order]
        firsts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        df = np.repeat(np.add.reduceat(n[order], firsts), np.diff(np.append(firsts, len(h))))
        often = df > 1
        found, lists = _lists(part[often], h[often], df[often])
        yield pa.record_batch([pa.array(found), *lists], ["part", "told", "dfs"])


def _bags_of_names(rows: pa.RecordBatch, weights: list[int]) -> pa.RecordBatch:
    """Rows of (doc, h, tf, x) from rows of (doc, hs, ms, ns), as ``features.hashed`` has them: equal names of an item are added up."""
    h, ns = rows.column(1).flatten().to_numpy(), rows.column(3).flatten().to_numpy().reshape(len(rows), -1)
    md5 = rows.column(2).flatten().cast(pa.binary(4))
    x = np.frombuffer(md5.buffers()[1] or b"", dtype=">u4")[md5.offset : md5.offset + len(md5)].astype(np.int64) % P
    item, weight = np.repeat(np.arange(len(rows)), ns.sum(axis=1)), np.repeat(np.tile(np.array(weights, dtype=np.int64), len(rows)), ns.ravel())
    order = np.lexsort((h, item))
    h, item = h[order], item[order]
    firsts = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (item[1:] != item[:-1]))[: len(h)])
    tf = np.add.reduceat(weight[order], firsts) if len(firsts) else np.empty(0, dtype=np.int64)
    ends = pa.array(np.append(0, np.cumsum(np.bincount(item[firsts], minlength=len(rows)))).astype(np.int32))
    return pa.record_batch([rows.column(0), *(pa.ListArray.from_arrays(ends, pa.array(c)) for c in (h[firsts], tf, x[order[firsts]]))], ["doc", "h", "tf", "x"])


def _valued(rows: pa.RecordBatch, known: np.ndarray, dfs: np.ndarray, docs: int, least_docs: int) -> pa.RecordBatch:
    """Rows of (doc, h, lists...), lists being tf and others of the same lengths, with v in place of h and tf; only of features with v > 0."""
    h, tf = rows.column(1).flatten().to_numpy(), rows.column(2).flatten().to_numpy()
    df = _df_of(h, known, dfs)
    v = np.log(1.0 + tf) * np.log((docs // df).astype(np.float64))
    keep = (v > 0) & (df >= least_docs)
    offsets = rows.column(1).offsets.to_numpy()
    ends = np.concatenate([[0], np.cumsum(keep)])[offsets - offsets[0]]
    whole = np.flatnonzero(np.diff(ends))
    ends = pa.array(np.append(ends[whole], ends[-1]).astype(np.int32))  # items without a feature left have no width
    mask = pa.array(keep)
    lists = [rows.column(i).flatten().filter(mask) for i in range(3, rows.num_columns)]
    lists.insert(1, pa.array(v[keep]))
    return pa.record_batch([rows.column(0).take(pa.array(whole)), *(pa.ListArray.from_arrays(ends, c) for c in lists)], ["doc", "x", "v", "feature"][: 1 + len(lists)])


def _with_frequencies(items: DataFrame, mode: Mode) -> tuple[DataFrame, int]:
    """``part, told, dfs, doc, text``: items (doc, text; a row each) in parts, and before those of a part what it is told; the number of items."""
    items, _ = written(items.select("doc", "text", F.monotonically_increasing_id().alias("_id")))
    docs, size = items.agg(F.count("*"), F.sum(F.length("text").cast("long"))).first()
    per = max(1, PART * docs // max(size or 0, 1))
    items = items.select("doc", "text", F.expr(f"_id div {per}").alias("part"))

    buckets = (size or 0) // BUCKET + 1
    hashes = features.distinct_hashes(items, mode).select("part", "hs")
    counts = hashes.mapInArrow(lambda batches: _counts_of_parts(batches, buckets), "bucket long, part long, hs array<long>, ns array<long>")
    told = counts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_told_of_buckets, "part long, told array<long>, dfs array<long>")
    known = told.select("part", F.lit(None).cast("string").alias("doc"), F.lit(None).cast("string").alias("text"), "told", "dfs")
    asking = items.select("part", "doc", "text", *(F.lit(None).cast("array<long>").alias(c) for c in ("told", "dfs")))
    return known.unionByName(asking).repartition("part").sortWithinPartitions("part", F.col("told").isNull()), docs


def _asking(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of items, some at a time, with the hashes that their part is told, sorted, and their frequencies."""
    part, told, table = None, [], None
    for batch in filter(len, batches):
        parts, asks = batch.column(0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False)
        begins = [0, *(np.flatnonzero((parts[1:] != parts[:-1]) | (asks[1:] != asks[:-1])) + 1), len(parts)]
        for a, b in zip(begins, begins[1:]):
            piece = batch.slice(a, b - a)
            if parts[a] != part:
                part, told, table = parts[a], [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))], None
            if not asks[a]:
                told.append((piece.column(1).flatten().to_numpy(), piece.column(2).flatten().to_numpy()))
                continue
            if table is None:
                h, df = (np.concatenate(c) for c in zip(*told))
                order = np.argsort(h)
                table, told = (h[order], df[order]), []
            for some in pieces(piece.select(range(3, piece.num_columns))):
                yield some, *table


def _df_of(h: np.ndarray, known: np.ndarray, dfs: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.ones(len(h), dtype=np.int64)
    place = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[place] == h, dfs[place], 1)


def frequent_features(items: DataFrame, mode: Mode) -> DataFrame:
    """``feature, doc, weight``: what ``features.extract`` gives for items (doc, text; a row each) without trees.

    Features of too few documents are left out in their item's row: no feature moves with its document.
    """
    rows, _ = _with_frequencies(items, mode)
    hs, names, weights = F.transform("f", lambda f: F.xxhash64(f["feature"])), F.col("f.feature"), F.col("f.weight")
    rows = features.counted(rows, mode).select("part", "told", "dfs", "doc", hs.alias("hs"), names.alias("names"), weights.alias("weights"))
    least_docs = mode.least_docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, known, dfs in _asking(batches):
            hs = some.column(1)
            keep = pa.array(_df_of(hs.flatten().to_numpy(), known, dfs) >= least_docs)
            docs = some.column(0).take(pa.array(np.repeat(np.arange(len(some)), np.diff(hs.offsets.to_numpy()))))
            yield pa.record_batch([c.filter(keep) for c in (some.column(2).flatten(), docs, some.column(3).flatten())], ["feature", "doc", "weight"])

    return rows.mapInArrow(run, "feature string, doc string, weight long")


def bags_in_rows(items: DataFrame, mode: Mode, named: bool = False) -> DataFrame:
    """``doc, x array<long>, v array<double>``: a row per item (doc, text; a row each) that has a feature of value over 0.

    ``x`` are hashes of features as ``wmh.packed`` has them, ``v`` their values; with ``named``, their names as ``feature``.
    """
    rows, docs = _with_frequencies(items, mode)
    if named:
        lists = [F.transform("f", lambda f: F.xxhash64(f["feature"])), F.transform("f", lambda f: f["weight"]), F.transform("f", lambda f: hash31(f["feature"])), F.col("f.feature")]
        rows = features.counted(rows, mode).select("part", "told", "dfs", "doc", *(c.alias(f"_{i}") for i, c in enumerate(lists)))
    else:
        rows = features.hashed(rows, mode).select("part", "told", "dfs", "doc", "hs", "ms", "ns")
    weights, least_docs = features.weights(mode), mode.least_docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, known, dfs in _asking(batches):
            yield _valued(some if named else _bags_of_names(some, weights), known, dfs, docs, least_docs)

    return rows.mapInArrow(run, f"doc string, x array<long>, v array<double>{', feature array<string>' if named else ''}")
