"""Communities inside connected components of the element - bucket graph.

Components of one or two elements are communities as they are.  Others are split by an algorithm that is chosen by name:

``louvain`` (Blondel and others), the same at every size: rounds in which vertices move to the neighbouring community
that raises modularity most, then a level on which communities are the vertices, until nothing moves.  Every round is a
few joins over the whole cluster.  Of two neighbours only one moves in a round (elements and buckets take turns; on
graphs without buckets a hash decides), a component keeps its best round and settles by itself, so components do not
influence each other.  Components of up to ``SMALL`` edges settle many at a time in the task that they are dealt to, by the
same rounds and with the same result; they are nearly all, and a round of joins takes a second however little moves.

``walktrap`` (Pons and Latapy): random walks of four steps give distances, neighbouring communities are merged by the
smallest growth in squared distance, and the merge of the largest modularity is kept.  A component is a group of one
task; one of over ``MOST`` vertices is refused.

``labels``: rounds of weighted label propagation until no label changes, or no round has more weight inside labels.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.lineage import cut, written
from twinsift.operators.lsh import quadratic_edges

STEPS = 4
MOST = 3000
HOT = 10_000  # edges of a vertex that one key of a join may have
SMALL = 100_000  # edges of a component that one task settles
ROUNDS, LEVELS = 60, 30


def walktrap(n: int, edges: list[tuple[int, int, float]], steps: int = STEPS) -> list[int]:
    """Community of each of n vertices of a connected weighted graph; vertices get a loop, as walks need one."""
    w = np.zeros((n, n))
    for a, b, x in edges:
        w[a, b] += x
        w[b, a] += x
    loops = np.array([row[row > 0].mean() if (row > 0).any() else 1.0 for row in w])
    walk = w + np.diag(loops)
    degree = walk.sum(1)
    p = np.linalg.matrix_power(walk / degree[:, None], steps) / np.sqrt(degree)[None]
    total = w.sum()
    if not total:
        return list(range(n))
    size, mean = np.ones(n), {i: p[i] for i in range(n)}
    inside, volume = {i: 0.0 for i in range(n)}, {i: w[i].sum() for i in range(n)}
    links = {i: {j: w[i, j] for j in np.flatnonzero(w[i]) if j != i} for i in range(n)}
    sizes = dict(enumerate(size))
    gain = lambda a, b: float(f"{sizes[a] * sizes[b] / (sizes[a] + sizes[b]) * ((mean[a] - mean[b]) ** 2).sum():.9e}")  # noqa: E731 - ties of rounding go to indices
    heap = [(gain(a, b), a, b) for a in range(n) for b in links[a] if a < b]
    heapq.heapify(heap)
    share = lambda c: inside[c] / total - (volume[c] / total) ** 2
    modularity = sum(share(c) for c in range(n))
    merges, best, best_at, new = [], modularity, 0, n
    while heap:
        _, a, b = heapq.heappop(heap)
        if a not in links or b not in links:
            continue
        modularity -= share(a) + share(b)
        sizes[new] = sizes[a] + sizes[b]
        mean[new] = (sizes[a] * mean.pop(a) + sizes[b] * mean.pop(b)) / sizes[new]
        inside[new], volume[new] = inside[a] + inside[b] + 2 * links[a].get(b, 0.0), volume[a] + volume[b]
        near: dict[int, float] = {}
        for c in (a, b):
            for d, x in links.pop(c).items():
                if d not in (a, b):
                    near[d] = near.get(d, 0.0) + x
                    links[d].pop(c, None)
        links[new] = near
        for d, x in near.items():
            links[d][new] = x
            heapq.heappush(heap, (gain(d, new), d, new))
        modularity += share(new)
        merges.append((a, b, new))
        if modularity > best + 1e-12:
            best, best_at = modularity, len(merges)
        new += 1
    owner = list(range(n))
    top = {i: i for i in range(n)}
    for a, b, c in merges[:best_at]:
        for v in range(n):
            if top[v] in (a, b):
                top[v] = c
    names: dict[int, int] = {}
    for v in range(n):
        owner[v] = names.setdefault(top[v], v)
    return owner


def graph_of(linear: DataFrame, components: DataFrame, edges: str) -> DataFrame:
    """``component, a, b, weight``: each edge once.  Vertices are strings, elements begin with 0 and buckets with 1.

    ``linear``: elements and their buckets, weighted by the bucket's size.  ``quadratic``: elements that share a bucket,
    each pair once whatever they share, unweighted; it grows with the square of a bucket.
    """
    placed = components.select("component", F.col("node").alias("doc"))
    name = lambda c: F.concat(F.lit("0"), F.col(c).cast("string"))
    if edges == "linear":
        bucket = F.concat(F.lit("1"), F.concat_ws(":", "hashtable", "value"))
        return linear.join(placed, "doc").select("component", name("doc").alias("a"), bucket.alias("b"), F.col("weight").cast("double").alias("weight"))
    pairs = quadratic_edges(linear)
    return pairs.join(placed.withColumnRenamed("doc", "a"), "a").select("component", name("a").alias("a"), name("b").alias("b"), F.lit(1.0).alias("weight"))


def _both_ways(graph: DataFrame) -> DataFrame:
    """``component, u, v, w`` with each edge from both ends."""
    both = graph.select("component", F.col("a").alias("u"), F.col("b").alias("v"), F.col("weight").alias("w"))
    return both.unionByName(both.where("u <> v").select("component", F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def _salted(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``both`` with ``salt``, and ``u, salts``: among how many keys the edges to vertex u are dealt."""
    salts = both.groupBy("u").agg(F.ceil(F.count("*") / HOT).cast("int").alias("salts"))
    hot = salts.where("salts > 1").withColumnRenamed("u", "v")  # few: each has HOT edges
    dealt = both.join(F.broadcast(hot) if hot.count() <= 100_000 else hot, "v", "left")
    return dealt.withColumn("salt", F.pmod(F.xxhash64("u"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts"), salts


def _level(both: DataFrame, turn: Callable[[Column, int], Column], resolution: float) -> DataFrame:
    """``component, u, label``: the best round of every component, from each vertex alone; a label is one of its vertices."""
    edges, salts = _salted(both)
    edges = cut(edges)
    loop = F.sum(F.when(F.col("u") == F.col("v"), F.col("w")).otherwise(0.0)).alias("loop")
    nodes = edges.groupBy("component", "u").agg(F.sum("w").alias("k"), loop)
    m2 = nodes.groupBy("component").agg(F.sum("k").alias("m2"))
    nodes = nodes.join(m2, "component").join(salts, "u")
    # What a vertex is in (now) and was in the round before (c), what it adds to the quality of that round and whether it
    # would rather move; the best so far (label, at quality best), and for how many rounds nothing was better.
    state = nodes.select("component", "u", "k", "loop", "m2", "salts", F.col("u").alias("now"), F.col("u").alias("c"), F.lit(None).cast("double").alias("inside"), F.lit(True).alias("restless"),
                         F.col("u").alias("label"), F.lit(float("-inf")).alias("best"), F.lit(0).alias("idle"))
    # Each round is a written table: a checkpoint remembers how its plan was partitioned, and planning slows down with every round.
    state, path = written(state)
    for number in range(ROUNDS):
        seen = state.select(F.col("u").alias("v"), F.col("now").alias("to"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        toward = edges.where("u <> v").join(seen, ["v", "salt"]).groupBy("u", "to").agg(F.sum("w").alias("w"))
        held = state.groupBy(F.col("now").alias("to")).agg(F.sum("k").alias("held"))
        # A vertex without neighbours outside still has its own community, an offer of weight 0.
        offers = toward.unionByName(state.select("u", F.col("now").alias("to"), F.lit(0.0).alias("w"))).groupBy("u", "to").agg(F.sum("w").alias("w"))
        offers = offers.join(state.select("u", "k", "m2", "now"), "u").join(held, "to")
        own = F.col("to") == F.col("now")
        score = F.round(F.col("w") - resolution * F.col("k") * (F.col("held") - F.when(own, F.col("k")).otherwise(0.0)) / F.col("m2"), 9)
        other = F.when(~own, F.struct((-score).alias("s"), F.col("to").alias("to")))
        of = offers.groupBy("u").agg(F.min(other).alias("o"), F.max(F.when(own, F.struct(score.alias("s"), "w", "held"))).alias("i"))
        before = state.groupBy("component").agg(F.round(F.sum("inside"), 12).alias("quality"), F.max("restless").alias("moving"))
        of = state.drop("restless").withColumnRenamed("inside", "was").join(of, "u").join(before, "component")
        better = F.coalesce(F.col("quality") > F.col("best") + 1e-11, F.lit(False))
        idle = F.when(F.col("quality").isNull() | better, 0).otherwise(F.col("idle") + 1)
        label = F.when(better, F.col("c")).otherwise(F.col("label"))
        done = (idle > 2) | ~F.col("moving")
        gains = F.col("o").isNotNull() & (-F.col("o.s") > F.col("i.s") + 1e-9) & ~done
        single = F.abs(F.col("i.held") - F.col("k")) < 1e-9  # two vertices that are each alone must not change places
        moves = gains & turn(F.col("u"), number) & ~(single & (F.col("o.to") > F.col("now")) & turn(F.col("o.to"), number))
        inside = (F.col("i.w") + F.col("loop")) / F.col("m2") - resolution * F.col("k") * F.col("i.held") / (F.col("m2") * F.col("m2"))
        state, path = written(of.select("component", "u", "k", "loop", "m2", "salts", F.when(done, label).when(moves, F.col("o.to")).otherwise(F.col("now")).alias("now"), F.when(done, label).otherwise(F.col("now")).alias("c"),
                              F.when(done, F.col("was")).otherwise(inside).alias("inside"), gains.alias("restless"), label.alias("label"), F.greatest("best", F.coalesce("quality", F.col("best"))).alias("best"), idle.alias("idle")), path)
        if number and not state.agg(F.max("restless")).first()[0]:
            break
    # The last round's quality is not in the labels yet.
    before = state.groupBy("component").agg(F.round(F.sum("inside"), 12).alias("quality"))
    last = F.when(F.coalesce(F.col("quality") > F.col("best") + 1e-11, F.lit(False)), F.col("c")).otherwise(F.col("label"))
    return state.join(before, "component").select("component", "u", last.alias("label"))


def _by_kind(vertex: Column, number: int) -> Column:
    return vertex.startswith("0" if number % 2 == 0 else "1")


def _by_hash(vertex: Column, number: int) -> Column:
    return F.pmod(F.xxhash64(vertex, F.lit(number // 2)), F.lit(2)) == number % 2


def _turns(vertex: Column) -> Column:
    """The turns that ``_by_hash`` gives a vertex, a bit for two rounds."""
    bit = lambda i: F.shiftleft(F.pmod(F.xxhash64(vertex, F.lit(i)), F.lit(2)), i)
    return sum((bit(i) for i in range(1, (ROUNDS + 1) // 2)), bit(0))


def _settled(u: np.ndarray, v: np.ndarray, w: np.ndarray, of: np.ndarray, turn: Callable[[int], np.ndarray], resolution: float) -> np.ndarray:
    """What ``_level`` finds, for components in memory: the label of each vertex.

    ``u, v, w`` are edges from both ends between vertices that are numbered in the order of their names, ``of`` their
    components, numbered from 0.
    """
    n, parts = len(of), int(of.max()) + 1
    every = np.arange(n)
    k, loop = np.bincount(u, w, n), np.bincount(u[u == v], w[u == v], n)
    m2 = np.bincount(of, k)[of]
    u, v, w = (x[u != v] for x in (u, v, w))
    now = c = label = every
    inside, best, idle, moving = None, np.full(parts, -np.inf), np.zeros(parts, dtype=np.int64), np.ones(parts, dtype=bool)

    def improved() -> np.ndarray:
        nonlocal quality
        quality = np.round(np.bincount(of, inside, parts), 12)
        return quality > best + 1e-11

    quality = best
    for number in range(ROUNDS):
        better = np.zeros(parts, dtype=bool) if inside is None else improved()
        idle = np.where(better | (inside is None), 0, idle + 1)
        label, best = np.where(better[of], c, label), np.maximum(best, quality)
        done = ((idle > 2) | ~moving)[of]
        live = ~done[u]
        key, place = np.unique(np.concatenate([u[live] * n + now[v[live]], every * n + now]), return_inverse=True)
        weight = np.bincount(place, np.concatenate([w[live], np.zeros(n)]))
        at, to = np.divmod(key, n)
        held, own = np.bincount(now, k, n), to == now[at]
        score = np.round(weight - resolution * k[at] * (held[to] - np.where(own, k[at], 0.0)) / m2[at], 9)
        other = np.flatnonzero(~own)
        other = other[np.lexsort((to[other], -score[other], at[other]))]
        other = other[np.diff(at[other], prepend=-1) > 0]  # the best of each vertex
        target, most = now.copy(), np.full(n, -np.inf)
        target[at[other]], most[at[other]] = to[other], score[other]
        gains = (most > score[own] + 1e-9) & ~done
        mine, turns = held[now], turn(number)
        moves = gains & turns & ~((np.abs(mine - k) < 1e-9) & (target > now) & turns[target])
        add = (weight[own] + loop) / m2 - resolution * k * mine / (m2 * m2)
        inside = add if inside is None else np.where(done, inside, add)
        c, now = np.where(done, label, now), np.where(done, label, np.where(moves, target, now))
        moving = np.bincount(of[gains], minlength=parts) > 0
        if number and not moving.any():
            break
    return np.where(improved()[of], c, label)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that are sorted by their first column, in tables that do not cut its values."""
    rest: list[pa.RecordBatch] = []
    for batch in filter(len, batches):
        first, last = rest[0].column(0)[0] if rest else None, batch.column(0)[len(batch) - 1]
        if first is None or first != last:
            begin = pc.index(batch.column(0), last).as_py()  # of the value that is still open
            if rest or begin:
                yield pa.Table.from_batches([*rest, batch.slice(0, begin)])
            rest, batch = [], batch.slice(begin)
        rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def _louvain_in_tasks(graph: DataFrame, by_kind: bool, resolution: float, levels: int) -> DataFrame:
    """``louvain`` of components that fit in a task."""
    kind = graph.schema["component"].dataType.simpleString()
    rows = graph.select("component", "a", "b", "weight", _turns(F.col("a")).alias("ta"), _turns(F.col("b")).alias("tb"))

    def split(table: pa.Table) -> pa.RecordBatch:
        parts, a, b, w, ta, tb = (c.combine_chunks() for c in table.columns)
        ends = pa.concat_arrays([a, b])
        names = pc.unique(ends)
        names = names.take(pc.sort_indices(names))
        place = pc.index_in(ends, names).to_numpy().astype(np.int64)
        a, b = place[: len(a)], place[len(a) :]
        code = parts.dictionary_encode()
        of, bits = np.empty(len(names), dtype=np.int64), np.empty(len(names), dtype=np.int64)
        of[a] = of[b] = code.indices.to_numpy()
        bits[a], bits[b] = ta.to_numpy(), tb.to_numpy()
        element = pc.starts_with(names, "0").to_numpy(zero_copy_only=False)
        out = a != b
        u, v, w = np.concatenate([a, b[out]]), np.concatenate([b, a[out]]), np.concatenate([w.to_numpy(), w.to_numpy()[out]])
        # Of each level: its vertices as places in names, and their components.
        found, at, inside = np.arange(len(names)), np.arange(len(names)), of
        for level in range(levels):
            by_hash = lambda number: (bits[at] >> (number // 2)) % 2 == number % 2  # noqa: B023, E731
            turn = (lambda number: element == (number % 2 == 0)) if by_kind and not level else by_hash
            label = _settled(u, v, w, inside, turn, resolution)
            top = np.arange(len(names))
            top[at] = at[label]
            found = top[found]
            moved = np.zeros(len(code.dictionary), dtype=bool)
            moved[of[at[label != np.arange(len(label))]]] = True
            kept = moved[of[at[u]]]
            if not kept.any():
                break
            key, place = np.unique(top[at[u[kept]]] * len(names) + top[at[v[kept]]], return_inverse=True)
            w = np.bincount(place, w[kept])
            at, place = np.unique(np.concatenate(np.divmod(key, len(names))), return_inverse=True)
            u, v = place[: len(key)], place[len(key) :]
            inside = np.unique(of[at], return_inverse=True)[1]
        return pa.record_batch([code.dictionary.take(pa.array(of)), names, names.take(pa.array(found))], ["component", "u", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(split, _whole(batches))

    return rows.repartition("component").sortWithinPartitions("component").mapInArrow(run, f"component {kind}, u string, label string")


def louvain(graph: DataFrame, resolution: float = 1.0, levels: int = LEVELS) -> DataFrame:
    """``component, u, label`` of every vertex."""
    by_kind = graph.where("a like '0%' and b like '0%'").isEmpty()
    large = graph.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select("component")
    large = F.broadcast(cut(large))  # few: each has SMALL edges
    found = _louvain_in_tasks(graph.join(large, "component", "left_anti"), by_kind, resolution, levels)
    if large.isEmpty():
        return found
    return found.unionByName(_louvain_by_joins(graph.join(large, "component", "left_semi"), by_kind, resolution, levels))


def _louvain_by_joins(graph: DataFrame, by_kind: bool, resolution: float, levels: int) -> DataFrame:
    """``louvain`` of components of any size.  Levels are written tables, for the reason that rounds are."""
    both, path = written(_both_ways(graph))
    turn = _by_kind if by_kind else _by_hash
    found = done = None
    for _ in range(levels):
        level, _ = written(_level(both, turn, resolution))
        new = level if found is None else found.join(level.select(F.col("u").alias("label"), F.col("label").alias("top")), "label", "left").select("component", "u", F.coalesce("top", "label").alias("label"))
        found, done = written(new, done)
        turn = _by_hash
        joined = level.where("u <> label").select("component").distinct()  # others are settled
        up = level.join(joined, "component", "left_semi").select("u", "label")
        if up.isEmpty():
            break
        coarse = both.join(up, "u").withColumnRenamed("label", "a").join(up.select(F.col("u").alias("v"), F.col("label").alias("b")), "v")
        both, path = written(coarse.groupBy("component", F.col("a").alias("u"), F.col("b").alias("v")).agg(F.sum("w").alias("w")), path)
    return found


def propagated(graph: DataFrame) -> DataFrame:
    """``component, u, label`` by label propagation: one level of moves for weight alone."""
    both = cut(_both_ways(graph))
    turn = _by_hash if both.where("u like '0%' and v like '0%'").limit(1).count() else _by_kind
    return _level(both, turn, 0.0)


def _walktrap(graph: DataFrame) -> DataFrame:
    """``component, u, label``, a component in one task."""
    ends = graph.select("component", F.explode(F.array("a", "b")).alias("u"))
    large = ends.groupBy("component").agg(F.countDistinct("u").alias("n")).where(F.col("n") > MOST).agg(F.max("n")).first()[0]
    if large:
        raise ValueError(f"a component of {large} vertices is too large for walktrap ({MOST}): use louvain")
    kind = graph.schema["component"].dataType.simpleString()

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {v: i for i, v in enumerate(names)}
        found = walktrap(len(names), [(at[a], at[b], float(w)) for a, b, w in zip(pdf["a"], pdf["b"], pdf["weight"])])
        return pd.DataFrame({"component": pdf["component"].iloc[0], "u": names, "label": [names[i] for i in found]})

    return graph.groupBy("component").applyInPandas(split, f"component {kind}, u string, label string")


#: Each takes a graph (``graph_of``) and parameters of its own, and gives ``component, u, label``; others may be added.
ALGORITHMS: dict[str, Callable[..., DataFrame]] = {"louvain": louvain, "walktrap": _walktrap, "labels": propagated}


def communities(linear: DataFrame, components: DataFrame, algorithm: str = "louvain", edges: str = "linear", **parameters: float) -> DataFrame:
    """``community, element`` from linear edges (doc, hashtable, value, weight) and components (node, component).

    A community is named by its smallest element; communities of one element are kept here and left out of reports.
    ``edges``: see ``graph_of``.  ``parameters`` go to the algorithm.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}: one of {', '.join(ALGORITHMS)}")
    if edges not in ("linear", "quadratic"):
        raise ValueError(f"unknown edges {edges!r}: linear or quadratic")
    placed = cut(components.select("node", "component"))
    kind = placed.schema["node"].dataType.simpleString()
    sizes = placed.groupBy("component").agg(F.count("*").alias("elements"))
    tiny = placed.join(sizes.where("elements <= 2"), "component", "left_semi").select(F.col("component").alias("community"), F.col("node").alias("element"))
    large = placed.join(sizes.where("elements > 2"), "component", "left_semi")
    graph = cut(graph_of(linear, large, edges))
    if graph.isEmpty():
        return tiny
    found = ALGORITHMS[algorithm](graph, **parameters).where("u like '0%'").select("component", F.substring("u", 2, 1 << 30).cast(kind).alias("element"), "label")
    first = found.groupBy("component", "label").agg(F.min("element").alias("community"))
    return tiny.unionByName(found.join(first, ["component", "label"]).select("community", "element"))
