"""Weighted MinHash by consistent weighted sampling.

The random parameters of a (sample, feature) pair are computed from the feature's hash by modular arithmetic, so
there is no parameter matrix to build, broadcast or keep, and a grown vocabulary changes no signature.  For sample s
and stream i: ``u = ((a * x + b) mod P + 0.5) / P`` with a and b from MD5 and x the feature's 31-bit hash; then
``r = -ln(u0 u1)`` and ``c = -ln(u2 u3)`` are Gamma(2, 1) and ``beta = u4`` is uniform.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.functions.hashing import hash31, uint32_le

P = (1 << 31) - 1
STREAMS = 5
CELLS = 100_000  # samples times features that are held at a time: the arrays of a step stay in the processor's cache
BOUNDED_CELLS, BOUNDED_WIDTH = 150_000, 2_000  # the same where samples are bounded before they are drawn, and of how many features
BOUNDED = 16  # features a document, from which bounds are worth their time
LEVELS = (2.0, 10.0, np.inf)  # what a winner is first expected to be below, times the sum of its document's values
HEX = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), dtype=np.uint16)


def constants(samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets, samples x streams."""
    value = lambda kind, s, i: int(hashlib.md5(f"{kind}:{s}:{i}".encode()).hexdigest()[:8], 16)
    a = [[1 + value("a", s, i) % (P - 1) for i in range(STREAMS)] for s in range(samples)]
    b = [[value("b", s, i) % P for i in range(STREAMS)] for s in range(samples)]
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def _draw(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``((a x + b) mod P + 0.5) / P``, samples x features; P is a Mersenne number, so the remainder needs no division."""
    return _drawn(x[None], a[:, None], b[:, None])


def _drawn(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    v = a * x + b
    v = (v & P) + (v >> 31)
    v -= (v >= P) * P
    return (v + 0.5) / P


def _step(x: np.ndarray, logs: np.ndarray, begins: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winners of documents that begin at ``begins`` of the features, samples x documents."""
    beta = _draw(x, a[:, 4], b[:, 4])
    r = -np.log(_draw(x, a[:, 0], b[:, 0]) * _draw(x, a[:, 1], b[:, 1]))
    level = np.floor(logs / r + beta)
    ln_a = np.log(-np.log(_draw(x, a[:, 2], b[:, 2]) * _draw(x, a[:, 3], b[:, 3]))) - (level - beta) * r - r
    least = np.minimum.reduceat(ln_a, begins, axis=1)
    sizes = np.diff(np.append(begins, len(x)))
    place = np.where(ln_a == np.repeat(least, sizes, axis=1), np.arange(len(x)), len(x))
    best = np.minimum.reduceat(place, begins, axis=1)
    return x[best], np.take_along_axis(level, best, axis=1).astype(np.int64)


def _planes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Streams 0 to 3 x samples x 3: times (x div 2**16, x mod 2**16, 1) they give the draws up to a whole number, 0 and 1 some
    4e-11 too small and 2 and 3 as much too large; rounding adds less than 3e-11 to either side.
    """
    both = np.stack([(a[:, :4] << 16) % P, a[:, :4], b[:, :4] + np.array([0.4, 0.4, 0.6, 0.6])], axis=2)
    return np.ascontiguousarray(both.transpose(1, 0, 2)) / P


def _bounded_step(x: np.ndarray, value: np.ndarray, logs: np.ndarray, begins: np.ndarray, a: np.ndarray, b: np.ndarray, planes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``_step`` gives, drawn only where a bound without logarithms leaves a chance.

    With ``p = u2 u3`` the value that is smallest at the winner is at least ``2 (1 - p) / (1 + p) u0 u1 / value``.  Values are exponential
    with the document's ``value`` as rates, so the smallest one of a document is rarely over a few parts of their sum: features of
    higher bounds are drawn only where none below was found.  ``room``: three rows for arrays, as new ones would cost more than their sums.
    """
    n, docs = len(x), len(begins)
    sizes = np.diff(np.append(begins, n))
    parts = np.stack([x >> 16, x & 0xFFFF, np.ones(n, dtype=np.int64)]).astype(np.float64)
    low, u, whole = (r[: len(a) * n].reshape(len(a), n) for r in room)

    def draw(i: int, out: np.ndarray) -> None:
        np.dot(planes[i], parts, out=out)
        np.subtract(out, np.floor(out, out=whole), out=out)

    draw(2, low)
    draw(3, u)
    low *= u
    np.subtract(1.0, low, out=u)
    low += 1.0
    np.divide(u, low, out=low)
    doc, total = np.repeat(np.arange(docs), sizes), np.add.reduceat(value, begins)
    low *= 2.0 * total[doc] / value
    for i in (0, 1):
        draw(i, u)
        low *= u
    ln_total = np.tile(np.log(total), len(a))
    k, t = np.empty(len(a) * docs, dtype=np.int64), np.empty(len(a) * docs, dtype=np.int64)
    open_ = np.ones(len(a) * docs, dtype=bool)
    for level in LEVELS:
        chance = low <= level
        if level != LEVELS[0]:
            chance &= np.repeat(open_.reshape(-1, docs), sizes, axis=1)
        counts = np.count_nonzero(chance, axis=1)
        f = np.flatnonzero(chance) - np.repeat(np.arange(len(a)) * n, counts)
        of = lambda m: np.repeat(m, counts)  # noqa: B023, E731
        xs = x[f]
        u_of = lambda i: _drawn(xs, of(a[:, i]), of(b[:, i]))  # noqa: B023, E731
        beta = u_of(4)
        r = -np.log(u_of(0) * u_of(1))
        steps = np.floor(logs[f] / r + beta)
        ln_a = np.log(-np.log(u_of(2) * u_of(3))) - (steps - beta) * r - r
        group = of(np.arange(len(a)) * docs) + doc[f]
        firsts = np.flatnonzero(np.diff(group, prepend=-1))
        if len(firsts):
            least = np.minimum.reduceat(ln_a, firsts)
            place = np.where(ln_a == np.repeat(least, np.diff(np.append(firsts, len(f)))), np.arange(len(f)), len(f))
            best, at = np.minimum.reduceat(place, firsts), group[firsts]
            k[at], t[at] = xs[best], steps[best].astype(np.int64)
            open_[at] = least + ln_total[at] > np.log(level) - 1e-9
        if not open_.any():
            break
    return k.reshape(-1, docs), t.reshape(-1, docs)


def signatures_of(x: np.ndarray, value: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winning feature hash and level, documents x samples, of documents of ``sizes`` (all over 0) features one after the other.

    Many documents are signed at a time; one of very many features goes a few samples at a time.  Ties go to the smaller hash.
    """
    order = np.lexsort((x, np.repeat(np.arange(len(sizes)), sizes)))
    x, value = x[order], value[order]
    logs, planes = np.log(value), _planes(a, b)
    ends = np.cumsum(sizes)
    k, t = np.empty((len(sizes), len(a)), dtype=np.int64), np.empty((len(sizes), len(a)), dtype=np.int64)
    first, bounded = 0, len(x) >= BOUNDED * len(sizes)
    cells, width = (BOUNDED_CELLS, BOUNDED_WIDTH) if bounded else (CELLS, CELLS // len(a))
    room = np.empty((3, max(cells, width, int(sizes.max(initial=0))))) if bounded else None
    while first < len(sizes):
        begin = int(ends[first] - sizes[first])
        last = max(first + 1, int(np.searchsorted(ends, begin + width, side="right")))
        end = int(ends[last - 1])
        step = max(1, cells // (end - begin))
        begins = ends[first:last] - sizes[first:last] - begin
        for s in range(0, len(a), step):
            some = slice(s, s + step)
            if bounded:
                ks, ts = _bounded_step(x[begin:end], value[begin:end], logs[begin:end], begins, a[some], b[some], planes[:, some], room)
            else:
                ks, ts = _step(x[begin:end], logs[begin:end], begins, a[some], b[some])
            k[first:last, s : s + step], t[first:last, s : s + step] = ks.T, ts.T
        first = last
    return k, t


def signature_of(x: np.ndarray, value: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winning feature hash and level of each sample of one document."""
    k, t = signatures_of(x, value, np.array([len(x)]), a, b)
    return k[0], t[0]


def packed(bags: DataFrame) -> DataFrame:
    """``doc, x array<long>, v array<double>``: a document's bag (doc, feature, value) meets in one row.

    Rows are shuffled and sorted once by their document, and a sweep over them cuts where it changes: a task holds no more
    than a batch and a bag.
    """
    rows = bags.where("value > 0").select("doc", hash31(F.col("feature")).alias("x"), "value").repartition("doc").sortWithinPartitions("doc")

    def rows_of(docs: pa.Array, x: pa.Array, v: pa.Array, ends: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array(ends.astype(np.int32))
        return pa.record_batch([docs.take(pa.array(ends[:-1])), pa.ListArray.from_arrays(offsets, x), pa.ListArray.from_arrays(offsets, v)], ["doc", "x", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # rows of the document that is still open
        for batch in filter(len, batches):
            docs = batch.column(0)
            begins = np.flatnonzero(pc.not_equal(docs[1:], docs[:-1]).to_numpy(zero_copy_only=False)) + 1
            if rest and docs[0] != rest[0].column(0)[0]:
                begins = np.concatenate([[0], begins])
            if not len(begins):
                rest.append(batch)
                continue
            done = [*rest, batch.slice(0, int(begins[-1]))]
            held = sum(map(len, rest))
            columns = [pa.concat_arrays([d.column(i) for d in done]) for i in range(3)]
            first = [0] if held + begins[0] else []
            yield rows_of(*columns, np.array([*first, *(held + begins)], dtype=np.int64))
            rest = [batch.slice(int(begins[-1]))]
        if rest:
            columns = [pa.concat_arrays([d.column(i) for d in rest]) for i in range(3)]
            yield rows_of(*columns, np.array([0, len(columns[0])], dtype=np.int64))

    return rows.mapInArrow(run, f"doc {_doc_type(bags)}, x array<long>, v array<double>")


def _signed(batch: pa.RecordBatch, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, v = batch.column(1), batch.column(2)
    return signatures_of(x.flatten().to_numpy(), v.flatten().to_numpy(), np.diff(x.offsets.to_numpy()), a, b)


def pieces(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """A batch in slices, so that what a task holds beside it is small."""
    return (batch.slice(i, rows) for i in range(0, len(batch), rows))


def _doc_type(bags: DataFrame) -> str:
    return bags.schema["doc"].dataType.simpleString()


def signatures(bags: DataFrame, samples: int) -> DataFrame:
    """``doc, ks array<long>, ts array<long>`` from bags (doc, feature, value)."""
    return signatures_of_packed(packed(bags), samples)


def signatures_of_packed(rows: DataFrame, samples: int) -> DataFrame:
    """The same from ``packed`` bags."""
    a, b = constants(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * samples)
            lists = [pa.ListArray.from_arrays(ends, pa.array(m.ravel())) for m in _signed(batch, a, b)]
            yield pa.record_batch([batch.column(0), *lists], ["doc", "ks", "ts"])

    return rows.select("doc", "x", "v").mapInArrow(run, f"doc {_doc_type(rows)}, ks array<long>, ts array<long>")


def _words(batch: pa.RecordBatch, a: np.ndarray, b: np.ndarray, tables: int, size: int) -> np.ndarray:
    """What the bands of a batch are made of: (document, table) x sample x (k, t), four bytes each."""
    k, t = _signed(batch, a, b)
    both = np.stack([k, t], axis=2)[:, : tables * size].astype("<i8").view("<u4")[..., ::2]
    return np.ascontiguousarray(both).reshape(len(batch) * tables, size, 2)


def _digests(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 128-bit hash of each band and its table, as two long columns."""
    both, out = np.ascontiguousarray(words).view("<u8")[..., 0], np.empty((len(words), 2), dtype=np.uint64)
    for i, seed in enumerate((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)):
        h = (table.astype(np.uint64) + np.uint64(1)) * np.uint64(seed)
        for j in range(both.shape[1]):
            h ^= both[:, j]  # the finaliser of SplitMix64 after every word
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = (h ^ (h >> np.uint64(31))) + np.uint64(seed)
        out[:, i] = h
    return out.view(np.int64)


def _values(words: np.ndarray) -> pa.StringArray:
    """Bands as hex, lowest byte first."""
    raw = np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1)
    ends = np.arange(len(words) + 1, dtype=np.int32) * (2 * raw.shape[1])
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(ends), pa.py_buffer(HEX[raw]))


def bands_of_packed(rows: DataFrame, samples: int, tables: int, size: int) -> DataFrame:
    """``doc, hashtable, value`` as ``bands(signatures(...))`` gives them, from ``packed`` bags; made whole in the task that signs.

    With a column ``only`` (array of tables): those bands alone, and with ``h, g``, their digest.
    """
    a, b = constants(samples)
    chosen = "only" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, (p for b_ in batches for p in pieces(b_))):
            words = _words(batch, a, b, tables, size)
            place = np.arange(len(words))
            if chosen:
                only = batch.column(3)
                place = np.repeat(np.arange(len(batch)), np.diff(only.offsets.to_numpy())) * tables + only.flatten().to_numpy()
            words = words[place]
            out = [batch.column(0).take(pa.array(place // tables)), pa.array((place % tables).astype(np.int32)), _values(words)]
            names = ["doc", "hashtable", "value"]
            if chosen:
                digests = _digests(words, place % tables)
                out, names = [*out, pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy())], [*names, "h", "g"]
            yield pa.record_batch(out, names)

    return rows.select("doc", "x", "v", *(["only"] if chosen else [])).mapInArrow(run, f"doc {_doc_type(rows)}, hashtable int, value string{', h long, g long' if chosen else ''}")


def digests(rows: DataFrame, samples: int, tables: int, size: int) -> DataFrame:
    """``doc, hashtable, h``: bands of ``packed`` bags by a hash of 64 bits in place of their value, a tenth of its size."""
    a, b = constants(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, (p for b_ in batches for p in pieces(b_))):
            words = _words(batch, a, b, tables, size)
            place = np.arange(len(words))
            h = _digests(words, place % tables)
            yield pa.record_batch([batch.column(0).take(pa.array(place // tables)), pa.array((place % tables).astype(np.int32)), pa.array(h[:, 0].copy())], ["doc", "hashtable", "h"])

    return rows.select("doc", "x", "v").mapInArrow(run, f"doc {_doc_type(rows)}, hashtable int, h long")


def digests_in_rows(rows: DataFrame, samples: int, tables: int, size: int) -> DataFrame:
    """``doc, h array<long>, g array<long>``: bands of ``packed`` bags by the two halves of a hash of 128 bits of table and value."""
    a, b = constants(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, (p for b_ in batches for p in pieces(b_))):
            words = _words(batch, a, b, tables, size)
            both = _digests(words, np.arange(len(words)) % tables)
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * tables)
            yield pa.record_batch([batch.column(0), *(pa.ListArray.from_arrays(ends, pa.array(both[:, i].copy())) for i in (0, 1))], ["doc", "h", "g"])

    return rows.select("doc", "x", "v").mapInArrow(run, f"doc {_doc_type(rows)}, h array<long>, g array<long>")


def signatures_sql(bags: DataFrame, samples: int) -> DataFrame:
    """The same by column expressions alone: the cross-check of ``signatures``.

    Rows of a bag meet by their document before its samples are drawn, and winners are kept feature by feature: no row per sample
    and feature is shuffled, sorted or held.
    """
    rows = bags.where("value > 0").select("doc", hash31(F.col("feature")).alias("x"), F.log("value").alias("ln_v")).repartition("doc")

    def winner(a: list[int], b: list[int]) -> Column:
        u = [((F.lit(m).cast("long") * F.col("x") + F.lit(n).cast("long")) % P + 0.5) / P for m, n in zip(a, b)]
        r, beta = -F.log(u[0] * u[1]), u[4]
        t = F.floor(F.col("ln_v") / r + beta)
        return F.min(F.struct((F.log(-F.log(u[2] * u[3])) - (t - beta) * r - r).alias("a"), F.col("x").alias("k"), t.alias("t")))

    drawn = [winner(*(m.tolist() for m in ab)) for ab in zip(*constants(samples))]
    best = rows.groupBy("doc").agg(F.array(*drawn).alias("m")).select("doc", F.posexplode("m").alias("s", "m"))
    return best.select("doc", "s", "m.k", "m.t")


def long_form(signatures: DataFrame) -> DataFrame:
    """``doc, s, k, t``."""
    both = signatures.select("doc", F.posexplode(F.arrays_zip("ks", "ts")).alias("s", "m"))
    return both.select("doc", "s", F.col("m.ks").alias("k"), F.col("m.ts").alias("t"))


def _band(i: Column, size: int) -> Column:
    ks, ts = F.slice("ks", i * size + 1, size), F.slice("ts", i * size + 1, size)
    return F.array_join(F.zip_with(ks, ts, lambda k, t: F.concat(uint32_le(k), uint32_le(t))), "")


def bands(signatures: DataFrame, tables: int, size: int) -> DataFrame:
    """``doc, hashtable, value``: for each table the hex of its samples' (k, t), four bytes each, lowest first."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda i: _band(i, size))
    return signatures.select("doc", F.posexplode(cut).alias("hashtable", "value"))
