"""K-d tree partitioning of documents into byte-balanced shards.

Documents with equal texts form one group that is never split.  Groups are points in a metadata space (size,
language, source); the node that still has several shards to fill is split at a distributed weighted median
along its widest dimension until every leaf holds one shard's target bytes.

The text is read once, to hash and measure it; only narrow rows are shuffled.  A median is found by rounds of
byte histograms with a fixed number of bins per node, so what reaches the driver depends on the number of shards
alone.  Ties in a dimension (a source with a third of all rows) are broken by the group's hash, which makes every
coordinate continuous.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.lineage import cut
from twinsift.llm.texts import packed, row_key, text_bytes
from twinsift.operators.numbering import gapless_slots, order_numbers

LEVELS = 1 << 20  # integer steps of a dimension; the fraction in between breaks ties
BINS = 4096
ROUNDS = 3
LEAST_STEP = 1e-12  # of a bin, where the ends of a range have met
BROADCAST_VALUES = 100_000  # languages or sources whose places are broadcast; more are joined by shuffle
DIMENSIONS = ("_size", "_lang", "_source")


@dataclass(frozen=True)
class Split:
    node: int
    dimension: str
    at: float


def _group() -> Column:
    """Equal texts have equal groups; a null text counts as an empty one."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("_group")


def text_groups(docs: DataFrame) -> DataFrame:
    """Narrow rows: doc_id, size, text_crc32, the group of equal texts and raw coordinates."""
    size = text_bytes() + 1
    return docs.select(
        "doc_id",
        size.alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        _group(),
        row_key(docs).alias("_key"),
        F.log2(size.cast("double")).alias("_size"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"),
    )


def _numbered(groups: DataFrame, c: str) -> DataFrame:
    """A string column as the place of its whole value among all values."""
    places = order_numbers(groups.select(c).distinct(), c, "_place")
    few = places.count() <= BROADCAST_VALUES
    return groups.join(F.broadcast(places) if few else places, c).withColumn(c, F.col("_place").cast("double")).drop("_place")


def _points(rows: DataFrame) -> DataFrame:
    """One row per group of equal texts: its bytes and its coordinates in [0, LEVELS + 1)."""
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_bytes"), *[F.min(d).alias(d) for d in DIMENSIONS])
    groups = cut(groups)
    for c in ("_lang", "_source"):
        groups = _numbered(groups, c)
    groups = cut(groups)
    ends = groups.agg(*[f(d).alias(f"{d}_{n}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    tie = F.pmod(F.xxhash64("_group", F.lit(8)), F.lit(1 << 30)).cast("double") / float(1 << 30)

    def scaled(d: str) -> Column:
        lo, hi = ends[f"{d}_lo"] or 0.0, ends[f"{d}_hi"] or 0.0
        return (F.floor((F.col(d) - F.lit(lo)) / F.lit((hi - lo) or 1.0) * F.lit(LEVELS)) + tie).alias(d)

    return cut(groups.select("_group", "_bytes", *[scaled(d) for d in DIMENSIONS], F.lit(0).alias("_node")))


def _by_node(values: dict[int, object], otherwise: object = None) -> Column:
    out = F.lit(otherwise)
    for node, v in values.items():
        out = F.when(F.col("_node") == node, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def _medians(points: DataFrame, dims: dict[int, str], goals: dict[int, float], ends: dict[int, tuple[float, float]]) -> dict[int, float]:
    """For each node the coordinate below which about ``goals[node]`` bytes lie, by histogram rounds."""
    below, crossing = dict.fromkeys(dims, 0.0), dict.fromkeys(dims, 0.0)
    ends = dict(ends)
    at = _by_node({n: F.col(d) for n, d in dims.items()})
    for _ in range(ROUNDS):
        steps = {n: max((e[1] - e[0]) / BINS, LEAST_STEP) for n, e in ends.items()}
        lo, width = _by_node({n: e[0] for n, e in ends.items()}), _by_node(steps)
        bins = points.where(F.col("_node").isin(list(dims))).select("_node", "_bytes", F.floor((at - lo) / width).alias("_bin"))
        found = bins.where((F.col("_bin") >= 0) & (F.col("_bin") < BINS)).groupBy("_node", "_bin").agg(F.sum("_bytes").alias("b")).collect()
        for n in dims:
            start, step = ends[n][0], steps[n]
            for b, weight in sorted((r["_bin"], r["b"]) for r in found if r["_node"] == n):
                if below[n] + weight >= goals[n]:
                    ends[n], crossing[n] = (start + b * step, start + (b + 1) * step), weight
                    break
                below[n] += weight
    # The bin that crosses the goal goes to the side where it leaves the smaller error.
    return {n: ends[n][1] if goals[n] - below[n] > crossing[n] / 2 else ends[n][0] for n in dims}


def kd_tree(points: DataFrame, n_shards: int) -> tuple[DataFrame, list[Split]]:
    """Points with their leaf number, and the splits from the root on."""
    nodes = {0: (0, n_shards)}  # node -> first shard, number of shards
    splits: list[Split] = []
    next_id = 1
    while open_nodes := {n: s for n, s in nodes.items() if s[1] > 1}:
        shape = points.where(F.col("_node").isin(list(open_nodes))).groupBy("_node").agg(
            F.sum("_bytes").alias("bytes"), *[f(d).alias(f"{d}_{k}") for d in DIMENSIONS for k, f in (("lo", F.min), ("hi", F.max))]
        )
        shape = {r["_node"]: r for r in shape.collect()}
        dims, goals, ends = {}, {}, {}
        for n, (_, k) in open_nodes.items():
            if (r := shape.get(n)) is None:
                continue  # no rows: its shards stay empty
            dims[n] = max(DIMENSIONS, key=lambda d: r[f"{d}_hi"] - r[f"{d}_lo"])
            goals[n] = r["bytes"] * (k // 2) / k
            ends[n] = (r[f"{dims[n]}_lo"], r[f"{dims[n]}_hi"] + 1e-6)
        cuts = _medians(points, dims, goals, ends) if dims else {}
        moves = {}
        for n, (first, k) in open_nodes.items():
            left, right = next_id, next_id + 1
            next_id += 2
            del nodes[n]
            nodes[left], nodes[right] = (first, k // 2), (first + k // 2, k - k // 2)
            if n in cuts:
                splits.append(Split(n, dims[n], cuts[n]))
                moves[n] = F.when(F.col(dims[n]) < cuts[n], left).otherwise(right)
        points = cut(points.withColumn("_node", F.coalesce(_by_node(moves), F.col("_node"))))
    shard = _by_node({n: first for n, (first, _) in nodes.items()})
    return points.withColumn("shard", shard.cast("int")), splits


def assign_shards(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row of ``docs`` (columns doc_id, text, lang, source).

    Sizes (UTF-8 bytes plus 1) of the shards are near equal; equal texts share a shard, so a text whose copies
    exceed a shard's share makes that shard larger.  Null texts count as empty: size 1, crc 0, one group; null
    lang or source count as the lowest value; repeated rows each get a slot, and rows under one doc_id are ordered by a hash of all
    their columns; an empty table gives an empty result; further columns have no other effect.
    """
    rows = cut(text_groups(docs))
    points, _ = kd_tree(_points(rows), n_shards)
    placed = rows.join(points.select("_group", "shard"), "_group")
    placed = cut(placed.select("doc_id", "size", "text_crc32", "_key", "shard"))
    return gapless_slots(placed, "shard", ["doc_id", "_key"], "slot").drop("_key")


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, folder: str = "shard") -> None:
    """Write ``docs`` as Parquet under one folder per shard, named ``folder=0`` and on.

    ``folder`` becomes a column when the whole path is read: choose another name if ``docs`` has it (it is refused).
    Null texts and repeated rows are placed as in ``assign_shards``; an empty table writes no shard.
    """
    if folder.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs have a column {folder!r}: name the folders otherwise")
    points, _ = kd_tree(_points(cut(text_groups(docs))), n_shards)
    shards = points.select(F.col("_group").alias("of"), F.col("shard").alias("at"))
    placed = packed(docs, group=_group()).join(shards, F.col("group") == F.col("of")).select("row.*", F.col("at").alias(folder))
    placed.write.mode("overwrite").partitionBy(folder).parquet(path)
