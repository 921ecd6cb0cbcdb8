"""Near-duplicate vectors by product quantisation.

Centroids (coarse inverted lists on two levels) and subspace codebooks of the residuals are fitted on a bounded sample,
in one task; every vector is indexed: its list, the codes of its residual and the exact error of its code.  A query visits
its own list and every list whose border lies within ``MARGIN`` of it.  There an asymmetric table-lookup distance to the
codes, loosened by each code's own error, can only let through too much, never too little; what passes is
reranked by the exact cosine in double precision.  So only the margin bears on recall; at the link distance itself
(0.2 for a cosine of 0.98) it would be exact, and the default, half of that, is measured in the tests.

The number of lists grows with the rows: the second level splits each list by the residuals to its centroid, and the
border rule holds on both levels.  Equal vectors are indexed once with their number.  Long lists are dealt into blocks,
and a task joins two blocks, a bounded number of pairs at a time.  A block yields counts per vector and a spanning
forest of its links, not its pairs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.lineage import cut
from twinsift.llm.simhash import _join
from twinsift.operators.components import connected_components

COSINE = 0.98
SAMPLE = 8192  # vectors that centroids and codebooks are fitted on, taken by hash
LIST_ROWS = 200  # vectors wanted in a list
SAMPLE_PER_CENTROID = 4
MARGIN = 0.1
SUBSPACES, CODES = 16, 16
BLOCK = 2048  # vectors of a list that a task takes on either side
CELLS = 1 << 20  # table-lookup distances that are held at a time
PAIRS = 1 << 15  # candidate pairs that are reranked at a time
PLACED = 512  # vectors that are placed at a time
ROUNDS = 8


@dataclass
class Index:
    centroids: np.ndarray  # lists of the first level x dims
    inner: np.ndarray  # residuals to them by which a list is split x dims
    books: list[np.ndarray]  # per subspace: codes x width
    parts: list[slice]

    def centre(self, at: int) -> np.ndarray:
        return self.centroids[at // len(self.inner)] + self.inner[at % len(self.inner)]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own list of each unit vector, and (row, list) of those it visits besides."""
        own, rows, lists = [], [], []
        for first in range(0, len(x), PLACED):
            part = x[first : first + PLACED]
            home, row, coarse = _visits(part, self.centroids)
            row, coarse = np.r_[np.arange(len(part)), row], np.r_[home, coarse]
            fine, sub, beside = _visits(part[row] - self.centroids[coarse], self.inner)
            at = coarse * len(self.inner) + fine
            own.append(at[: len(part)])
            rows += [row[len(part) :] + first, row[sub] + first]
            lists += [at[len(part) :], coarse[sub] * len(self.inner) + beside]
        return np.concatenate(own), np.concatenate(rows), np.concatenate(lists)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = np.stack([_nearest(residual[:, p], b) for p, b in zip(self.parts, self.books)], axis=1)
        back = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)
        return codes.astype(np.uint8), np.linalg.norm(residual - back, axis=1)

    def lookup(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries (their residuals to the list) to coded vectors, from one table per subspace."""
        total = np.zeros((len(residual), len(codes)), dtype=np.float32)
        for m, (p, book) in enumerate(zip(self.parts, self.books)):
            table = ((residual[:, p][:, None, :] - book[None]) ** 2).sum(2).astype(np.float32)
            total += table[:, codes[:, m]]
        return np.sqrt(total)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1) - 2 * x @ c.T).argmin(1)


def _visits(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and (row, centroid) of the others whose border lies within ``MARGIN``."""
    if len(c) == 1:
        return np.zeros(len(x), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    d2 = np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1) - 2 * x @ c.T, 0)
    own = d2.argmin(1)
    at, which = np.unique(own, return_inverse=True)
    between = np.sqrt(np.maximum((c[at] ** 2).sum(1)[:, None] + (c**2).sum(1) - 2 * c[at] @ c.T, 1e-18))
    near = (d2 - d2[np.arange(len(x)), own][:, None]) <= 2 * MARGIN * between[which]
    near[np.arange(len(x)), own] = False
    return own, *np.nonzero(near)


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        a = _nearest(x, c)
        sums, n = np.zeros_like(c), np.bincount(a, minlength=len(c))
        np.add.at(sums, a, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def fit_index(sample: np.ndarray, rows: int) -> Index:
    """From unit vectors of one dimension; ``rows`` is how many will be indexed."""
    dims, most = sample.shape[1], max(1, len(sample) // SAMPLE_PER_CENTROID)
    lists = int(min(most, max(1, rows // LIST_ROWS)))
    centroids = _kmeans(sample, lists, 1)
    residual = sample - centroids[_nearest(sample, centroids)]
    inner = int(min(most, max(1, rows // (LIST_ROWS * lists))))
    inner_centroids = _kmeans(residual, inner, 99) if inner > 1 else np.zeros((1, dims))
    residual = residual - inner_centroids[_nearest(residual, inner_centroids)]
    edges = np.linspace(0, dims, min(SUBSPACES, dims) + 1).astype(int)
    parts = [slice(a, b) for a, b in zip(edges, edges[1:])]
    return Index(centroids, inner_centroids, [_kmeans(residual[:, p], CODES, 2 + i) for i, p in enumerate(parts)], parts)


def matrix(vectors: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of lists in double precision, shorter ones filled up with zeros, which changes no cosine."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    ends = vectors.offsets.to_numpy()
    flat = vectors.values.to_numpy(zero_copy_only=False)
    size = np.diff(ends)
    out = np.zeros((len(vectors), dims), dtype=np.float64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat[ends[0] : ends[-1]]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(v: str) -> Column:
    """Not null, no null or non-finite component, not zero."""
    x = F.col(v)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    norm = F.aggregate(x, F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    return F.coalesce(x.isNotNull() & finite & (norm > 0) & (norm < float("inf")), F.lit(False))


@dataclass
class Side:
    """One side of a block: ids, vectors, how many rows each stands for, and its own list."""

    ids: np.ndarray
    x: np.ndarray
    many: np.ndarray
    home: np.ndarray


def block_links(index: Index, cosine: float, here: int, base: Side, sees: tuple[np.ndarray, np.ndarray], query: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links that each of base and query gains in a block of list ``here``, and a forest (two rows of ids) of its links.

    ``sees``: sorted (position in base * 2**32 + list) of the lists that base vectors visit.  A pair across two lists is
    found here and perhaps there: it counts in the lower list that sees it.
    """
    radius = np.sqrt(2 - 2 * cosine) + 1e-6
    centre = index.centre(here)
    codes, error = index.encode(_unit(base.x) - centre)
    residual, limit = _unit(query.x) - centre, (radius + error + 1e-4)[None, :]
    norm_q, norm_x = np.sqrt((query.x**2).sum(1)), np.sqrt((base.x**2).sum(1))
    gained_q, gained_x = np.zeros(len(query.ids)), np.zeros(len(base.ids))
    names, at = np.unique(np.r_[query.ids, base.ids], return_inverse=True)
    label, forest = np.arange(len(names)), []
    step = max(1, CELLS // max(1, len(base.ids)))
    for first in range(0, len(query.ids), step):
        i, j = np.nonzero(index.lookup(residual[first : first + step], codes) <= limit)
        i = i + first
        other = query.ids[i] != base.ids[j]
        i, j = i[other], j[other]
        for k in range(0, len(i), PAIRS):
            a, b = i[k : k + PAIRS], j[k : k + PAIRS]
            exact = (query.x[a] * base.x[b]).sum(1) / (norm_q[a] * norm_x[b]) >= cosine
            a, b = a[exact], b[exact]
            across = query.home[a] != here
            code = b * (1 << 32) + query.home[a]
            found = np.minimum(np.searchsorted(sees, code), max(0, len(sees) - 1))
            seen = (sees[found] == code) if len(sees) else np.zeros(len(code), dtype=bool)
            mine = ~(across & seen & (query.home[a] < here))
            a, b, across = a[mine], b[mine], across[mine]
            gained_q += np.bincount(a, weights=base.many[b], minlength=len(gained_q))
            gained_x += np.bincount(b[across], weights=query.many[a[across]], minlength=len(gained_x))  # inside a list both ends ask
            u, v = at[a], at[len(query.ids) + b]
            label, used = _join(label, u, v)
            forest.append(np.stack([names[u[used]], names[v[used]]]))
    return gained_q, gained_x, np.concatenate(forest, axis=1) if forest else np.zeros((2, 0), dtype=np.int64)


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Only vectors with equal, non-null labels and equal dimensions are compared.  Null vectors, zero vectors and
    those with a null or non-finite component link with nothing; so do rows with a null label.  Equal vectors link
    with each other without being paired.  A null id never names a component unless it has no other; repeated ids
    are rows of their own; an empty table gives an empty result; further columns are ignored.
    """
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"), F.col(label_col).alias("_label"))
    good = usable("_v") & F.col("_label").isNotNull()
    reps = rows.where(good).groupBy("_label", "_v").agg(F.min("_id").alias("low"), F.count("*").alias("_w"))
    reps = cut(reps.withColumn("rep", F.monotonically_increasing_id()).withColumn("_dim", F.size("_v")))
    size = reps.agg(F.count("*").alias("n"), F.max("_dim").alias("dims")).first()
    if not size["n"]:
        return rows.select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(_links(reps, size["n"], size["dims"], cosine))
    component = connected_components(found.where("other is not null").select(F.col("rep").alias("u"), F.col("other").alias("v")))
    counted = found.where("n is not null").groupBy("rep").agg(F.sum("n").alias("_n"))
    named = reps.join(counted, "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
    named = cut(named.select("_label", "_v", "low", (F.coalesce("_n", F.lit(0)) + F.col("_w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("root")))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "root").select("_label", "_v", "n_links", "component_id")
    linked = rows.where(good).join(named, ["_label", "_v"]).select("_id", "n_links", "component_id")
    alone = rows.where(~good).select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    kept = F.col("_id").eqNullSafe(F.col("component_id"))
    return linked.unionByName(alone).select(F.col("_id").alias(id_col), "n_links", "component_id", kept.alias("kept"))


def fitted(reps: DataFrame, n: int, dims: int) -> Index:
    """The index of a sample of at most ``SAMPLE`` vectors, fitted in one task: the driver receives centroids and codebooks alone."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [matrix(b.column(0), dims) for b in batches if b.num_rows]
        if held:
            yield pa.record_batch([pa.array([pickle.dumps(fit_index(_unit(np.concatenate(held)), n))])], ["index"])

    sample = reps.select("_v", "rep").orderBy(F.xxhash64("_v"), "rep").limit(SAMPLE).select("_v")
    return pickle.loads(sample.mapInArrow(fit, "index binary").first()["index"])


def _links(reps: DataFrame, n: int, dims: int, cosine: float) -> DataFrame:
    """``rep, n`` (links gained in a block) and ``rep, other`` (edges that span a block's links)."""
    shared = reps.sparkSession.sparkContext.broadcast(fitted(reps, n, dims))
    vector, label = (reps.schema[c].dataType.simpleString() for c in ("_v", "_label"))
    source = reps.select("rep", "_label", "_dim", "_v", "_w")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector as an indexed one (role 0) in its list, as a query (1) there and in every list it visits."""
        for whole in batches:
            for first in range(0, whole.num_rows, 2 * PLACED):
                batch = whole.slice(first, 2 * PLACED)
                own, row, visits = shared.value.place(_unit(matrix(batch.column(3), dims)))
                order = np.argsort(row, kind="stable")
                ends = np.searchsorted(row[order], np.arange(len(own) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(visits[order].astype(np.int32)))
                at = np.r_[np.arange(len(own)), np.arange(len(own)), row]
                role = np.repeat([0, 1], [len(own), len(own) + len(row)]).astype(np.int32)
                out = batch.take(pa.array(at))
                sees = pa.concat_arrays([lists, pa.nulls(len(at) - len(own), lists.type)])
                cols = [pa.array(x.astype(np.int32)) for x in (own[at], np.r_[own, own, visits], role)]
                yield pa.record_batch([*out.columns, *cols, sees], [*out.schema.names, "_home", "_list", "_role", "_sees"])

    schema = f"rep long, _label {label}, _dim int, _v {vector}, _w long, _home int, _list int, _role int, _sees array<int>"
    group = ["_label", "_dim", "_list"]
    placed = source.mapInArrow(place, schema)
    lists = source.mapInArrow(lambda batches: (b.select([*group, "_role"]) for b in place(batches)), f"_label {label}, _dim int, _list int, _role int")
    sizes = lists.groupBy(*group, "_role").count().where(F.col("count") > BLOCK)
    many = F.ceil(F.max("count") / BLOCK).cast("int")
    blocks = cut(sizes.groupBy(*group).pivot("_role", [0, 1]).agg(many).select(*group, F.col("0").alias("_nb"), F.col("1").alias("_nq")))
    placed = placed.join(F.broadcast(blocks) if blocks.count() <= 100_000 else blocks, group, "left")
    nb, nq = F.coalesce("_nb", F.lit(1)), F.coalesce("_nq", F.lit(1))
    base = F.col("_role") == 0
    own = F.pmod(F.xxhash64("rep", F.lit(5)), F.when(base, nb).otherwise(nq)).cast("int")
    others = F.sequence(F.lit(0), F.when(base, nq).otherwise(nb) - 1)
    placed = placed.withColumn("_own", own).withColumn("_other", F.explode(others))
    placed = placed.select("rep", *group, "_v", "_w", "_home", "_role", "_sees", F.when(base, F.col("_own")).otherwise(F.col("_other")).alias("_b"),
                           F.when(base, F.col("_other")).otherwise(F.col("_own")).alias("_q"))

    def join(table: pa.Table) -> pa.Table:
        role, lists = table["_role"].to_numpy(), table["_list"]
        sides = []
        for k in (0, 1):
            part = table.filter(pa.array(role == k))
            sides.append((part, Side(part["rep"].to_numpy(), matrix(part["_v"], dims), part["_w"].to_numpy().astype(float), part["_home"].to_numpy().astype(np.int64))))
        (indexed, b), (_, q) = sides
        if not len(b.ids) or not len(q.ids):
            return pa.table({"rep": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        seen = indexed["_sees"].combine_chunks()
        code = np.repeat(np.arange(len(b.ids)), np.diff(seen.offsets.to_numpy())) * (1 << 32) + seen.flatten().to_numpy()
        gained_q, gained_x, forest = block_links(shared.value, cosine, lists[0].as_py(), b, np.sort(code), q)
        ids, gained = np.r_[q.ids, b.ids], np.r_[gained_q, gained_x].astype(np.int64)
        ids, gained = ids[gained > 0], gained[gained > 0]
        none = pa.nulls(forest.shape[1], pa.int64())
        return pa.table({
            "rep": pa.array(np.r_[ids, forest[0]]), "n": pa.chunked_array([pa.array(gained), none]).combine_chunks(),
            "other": pa.chunked_array([pa.nulls(len(ids), pa.int64()), pa.array(forest[1].astype(np.int64))]).combine_chunks(),
        })

    return placed.groupBy(*group, "_b", "_q").applyInArrow(join, "rep long, n long, other long")
