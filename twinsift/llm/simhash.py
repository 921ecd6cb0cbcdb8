"""SimHash near-duplicates with BK-trees over shards of fingerprints.

Fingerprints that differ in at most ``RADIUS`` bits agree in one of ``RADIUS + 1`` blocks of bits, so each block's
value names a shard and links never leave the shards.  A shard's fingerprints form a BK-tree (children keyed by
their Hamming distance to the parent), and a search follows only edges within the radius of the query's distance.
Trees of all shards of a batch are built and searched level by level as arrays.

Shards meet their queries by a shuffle on the shard key, not by a broadcast: all trees together grow with the
corpus.  A shard that is too large (copies with small changes share blocks) is split again by the same rule on the
rest of its bits.  Searches skip subtrees that lie in the query's own component, so a dense group
costs a spanning forest, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.lineage import cut, shuffle_partitions
from twinsift.llm.texts import packed, row_key
from twinsift.operators.components import connected_components

RADIUS = 3
SHINGLE = 3
SEED = 42
SPLIT_SHARD = 1024  # a larger shard is split by blocks of its other bits
BATCH = 50_000  # fingerprints whose trees are built and searched at a time


def _hashes(text: bytes | None, size: int) -> list[int]:
    words = text.lower().split() if text else []
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    if len(words) < size:
        return [h(b" ".join(words), SEED)]
    if size == 3:
        return [h(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:])]
    return [h(b" ".join(words[i : i + size]), SEED) for i in range(len(words) - size + 1)]


PIECE = 1 << 16  # hashes whose bits are counted at a time


def fingerprint_of(text: bytes | None, size: int = SHINGLE) -> int:
    hashes = np.array(_hashes(text, size), dtype=">u8")
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), PIECE):
        bits = np.unpackbits(hashes[i : i + PIECE].view(np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) for every row."""
    return _with_keys(docs, size).drop("key")


def _with_keys(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, fp, key`` for every row; ``key`` is a hash of all its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint_of(t, size) for t in batch.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], ["doc_id", "fp", "key"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key(docs).alias("key"))
    return rows.mapInArrow(run, "doc_id long, fp long, key long")


def build_trees(fps: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of all shards (``shard`` sorted, values from 0): parent, key (distance to it) and level of each node.

    The first of a shard is its root.  Level by level, of those that reach a node with the same distance the first
    becomes its child and the others go on from there.
    """
    n = len(fps)
    parent, key, level = np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.zeros(0, dtype=np.int64)
    rest = np.setdiff1d(np.arange(n), first, assume_unique=True)
    at = first[np.searchsorted(first, rest, side="right") - 1]
    depth = 0
    while len(rest):
        depth += 1
        d = np.bitwise_count(fps[rest] ^ fps[at]).astype(np.int64)
        order = np.lexsort((rest, d, at))
        rest, at, d = rest[order], at[order], d[order]
        new = np.r_[True, (at[1:] != at[:-1]) | (d[1:] != d[:-1])]
        child = rest[new]
        parent[child], key[child], level[child] = at[new], d[new], depth
        at = np.repeat(child, np.diff(np.r_[np.flatnonzero(new), len(rest)]))
        rest, at = rest[~new], at[~new]
    return parent, key, level


def _roots(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unite the components of pairs; gives new labels and which pairs were needed to unite something."""
    used = np.zeros(len(a), dtype=bool)
    while len(a):
        la, lb = label[a], label[b]
        open_ = np.flatnonzero(la != lb)
        if not len(open_):
            break
        hi, lo = np.maximum(la[open_], lb[open_]), np.minimum(la[open_], lb[open_])
        _, pick = np.unique(hi, return_index=True)  # each component hangs itself under one smaller one
        used[open_[pick]] = True
        label[hi[pick]] = lo[pick]
        label = _roots(label)
    return label, used


def link_shards(fps: np.ndarray, shard: np.ndarray, radius: int = RADIUS, queries: int = 2048, frontier: int = 4_000_000) -> np.ndarray:
    """A spanning forest (pairs of positions) of the links within each shard; ``shard`` sorted, values from 0."""
    n = len(fps)
    label, forest = np.arange(n), []

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal label
        label, used = _join(label, a, b)
        forest.append(np.stack([a[used], b[used]], axis=1))

    parent, key, level = build_trees(fps, shard)
    child_order = np.lexsort((key, parent))
    begin = np.searchsorted(parent[child_order], np.arange(n), side="left")
    end = np.searchsorted(parent[child_order], np.arange(n), side="right")
    root = np.flatnonzero(parent < 0)
    root_of = root[np.searchsorted(root, np.arange(n), side="right") - 1]
    by_level = [np.flatnonzero(level == k) for k in range(level.max() + 1 if n else 0)]
    for q0 in range(0, n, queries):
        # one[v]: the component that v's whole subtree lies in, or -1
        one = label.copy()
        for nodes in by_level[:0:-1]:
            up = parent[nodes]
            mixed = up[one[nodes] != label[up]]
            one[mixed] = -1
        q = np.arange(q0, min(q0 + queries, n))
        stack = [(q, root_of[q])]
        while stack:
            q, v = stack.pop()
            if len(q) > frontier:
                half = len(q) // 2
                stack += [(q[:half], v[:half]), (q[half:], v[half:])]
                continue
            todo = one[v] != label[q]
            q, v = q[todo], v[todo]
            if not len(q):
                continue
            d = np.bitwise_count(fps[q] ^ fps[v]).astype(np.int64)
            hit = (d <= radius) & (label[q] != label[v])
            if hit.any():
                keep(q[hit], v[hit])
            low = begin[v] + _count_below(key, child_order, begin[v], end[v], d - radius)
            high = begin[v] + _count_below(key, child_order, begin[v], end[v], d + radius + 1)
            width = high - low
            total = int(width.sum())
            if total:
                offset = np.arange(total) - np.repeat(np.cumsum(width) - width, width)
                stack.append((np.repeat(q, width), child_order[np.repeat(low, width) + offset]))
    return np.concatenate(forest) if forest else np.zeros((0, 2), dtype=np.int64)


def _count_below(key: np.ndarray, order: np.ndarray, begin: np.ndarray, end: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many of the children ``order[begin:end]``, sorted by key, have keys below the limit."""
    lo, hi = begin.copy(), end.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo - begin
        mid = (lo + hi) // 2
        less = np.zeros(len(lo), dtype=bool)
        less[open_] = key[order[mid[open_]]] < limit[open_]
        lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)


def _block(fp: str, start: int, width: int):
    return F.shiftrightunsigned(F.col(fp), start).bitwiseAND(F.lit((1 << width) - 1))


def _shards(fps: DataFrame, radius: int) -> DataFrame:
    """``key, fp``: each fingerprint in the shards its blocks name; shards over the limit split once more."""
    blocks = radius + 1
    width = 64 // blocks
    coarse = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("i"))
    value = F.element_at(F.array(*[_block("fp", i * width, width) for i in range(blocks)]), F.col("i") + 1)
    coarse = coarse.select("fp", "i", value.alias("value"))
    sizes = coarse.groupBy("i", "value").agg(F.count("*").alias("n"))
    large = cut(sizes.where(F.col("n") > SPLIT_SHARD).select("i", "value", F.lit(True).alias("large")))
    if large.isEmpty():
        return coarse.select(F.xxhash64("i", "value").alias("key"), "fp")
    marked = coarse.join(F.broadcast(large) if large.count() <= 100_000 else large, ["i", "value"], "left")
    # The other bits of a large shard, in as many blocks again: bits i*width.. are equal there and left out.
    others = [[b for b in range(64) if not i * width <= b < (i + 1) * width] for i in range(blocks)]
    step = (64 - width) // blocks

    def gathered(bits: list[int]):
        out, k = F.lit(0).cast("long"), 0
        while k < len(bits):  # runs of neighbouring bits
            run = 1
            while k + run < len(bits) and bits[k + run] == bits[k] + run:
                run += 1
            out = out.bitwiseOR(F.shiftleft(_block("fp", bits[k], run), k))
            k += run
        return out

    fine = [F.array(*[gathered(others[i][j * step : (j + 1) * step if j < blocks - 1 else None]) for j in range(blocks)]) for i in range(blocks)]
    small = marked.where("large is null").select(F.xxhash64("i", "value").alias("key"), "fp")
    split = marked.where("large").select("fp", "i", "value", F.posexplode(F.element_at(F.array(*fine), F.col("i") + 1)).alias("j", "inner"))
    return small.unionByName(split.select(F.xxhash64("i", "value", "j", "inner").alias("key"), "fp"))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``u, v``: pairs of different fingerprints within the radius, enough to span every component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            shard = np.cumsum(np.r_[0, keys[1:] != keys[:-1]])
            pairs = link_shards(values.view(np.uint64), shard, radius)
            return pa.record_batch([pa.array(values[pairs[:, 0]]), pa.array(values[pairs[:, 1]])], ["u", "v"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(k) for k, _ in held) >= BATCH:
                keys, values = (np.concatenate(x) for x in zip(*held))
                last = np.searchsorted(keys, keys[-1])  # the last shard may go on
                if last:
                    yield solve(keys[:last], values[:last])
                held = [(keys[last:], values[last:])]
        if held and sum(len(k) for k, _ in held):
            yield solve(*(np.concatenate(x) for x in zip(*held)))

    dealt = _shards(fps, radius).repartition(shuffle_partitions(fps.sparkSession) * 2, "key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id`` for every row.

    component_id is the smallest doc_id reachable by links of at most ``radius`` differing bits.  A null, empty
    or all-blank text has fingerprint 0 and links like any other; texts shorter than a shingle are one shingle;
    repeated rows and exact copies share a fingerprint and are never paired; null ids are kept and never name a
    component unless it has no other; an empty table gives an empty result; further columns are ignored.
    """
    return _components(docs, radius, size).select("doc_id", "fp", "component_id")


def _components(docs: DataFrame, radius: int, size: int) -> DataFrame:
    """``doc_id, fp, key, component_id, root``: ``root`` tells components apart, whose smallest ids may be equal."""
    found = cut(_with_keys(docs, size))
    distinct = cut(found.groupBy("fp").agg(F.min("doc_id").alias("low")))
    component = connected_components(links(distinct.select("fp"), radius))
    named = distinct.join(component.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    named = cut(named)
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return found.join(named.join(lowest, "root").select("fp", "component_id", "root"), "fp").select("doc_id", "fp", "key", "component_id", "root")


def keep_one_of_each(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component, columns as they were, whatever their names.

    It is the row with the smallest doc_id, of several with that id the one with the smallest hash of all columns.  The
    decision is on rows: other texts under a kept or dropped id stay or go by their own component.  Rows without
    a doc_id all stay and make no other row go; an empty table gives an empty result.
    """
    known = docs.where("doc_id is not null")
    found = _components(known, radius, size)
    kept = found.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("k")).select(F.col("k.doc_id").alias("id"), F.col("k.key").alias("of"))
    rows = packed(known, key=row_key(docs)).join(kept, (F.col("key") == F.col("of")) & (F.col("row.doc_id") == F.col("id")))
    one = rows.dropDuplicates(["id", "of"]).select("row.*")  # rows equal in all columns
    return one.unionByName(docs.where("doc_id is null"))
