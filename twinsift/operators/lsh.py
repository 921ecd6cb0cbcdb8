"""Banded lookup, buckets and the choice of bands."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsift.lineage import cut, written
from twinsift.operators import wmh


BLOCK = 4096  # rows of a key that one task takes from either side
KNOWN = 2_000_000  # hashes that every task may hold
FEW = 250_000  # items that every task may hold
DIGEST = ["h", "g"]
CLASS = ["c", "d"]  # 128 bits of hash of all bands


def _blocks(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name)).where(F.col(name) > 1)


def dealt(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides of an inner join with ``_l`` and ``_r`` to join on besides ``keys``: the rows of a key that many have are
    dealt into blocks, and a task joins one block of either side.  Other keys have one block each.
    """
    hot = cut(_blocks(left, keys, "nl").join(_blocks(right, keys, "nr"), keys, "full"))  # a key has BLOCK rows at least
    hot = F.broadcast(hot) if hot.count() <= 100_000 else hot

    def side(rows: DataFrame, mine: str, other: str, own: str, every: str) -> DataFrame:
        block = F.pmod(F.xxhash64(*rows.columns, F.lit(3)), F.coalesce(mine, F.lit(1))).cast("int")
        all_of = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return rows.join(hot, keys, "left").select(*rows.columns, block.alias(own), all_of.alias(every))

    return side(left, "nl", "nr", "_l", "_r"), side(right, "nr", "nl", "_r", "_l")


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, a table, for a join: sent to every task unless it has over ``most``."""
    return F.broadcast(rows) if rows.count() <= most else rows


def candidate_classes(asked: DataFrame, digests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``candidates`` finds, as two tables to join on ``CLASS``: ``query_doc, c, d`` and ``c, d, doc``.

    From ``digests`` (``wmh.digests_in_rows``, a table) of all items for those in ``asked`` (doc).  Items with the same bands are a class, and
    classes are compared: copies of a line meet once, not once for every pair of them and band.  Bands that no asking item has are left
    out where they lie, by the first half of their hash.
    """
    asked, _ = written(asked.select("doc"))
    named = digests.select("doc", *DIGEST, F.xxhash64(*DIGEST).alias("c"), F.xxhash64(F.lit(7), *reversed(DIGEST)).alias("d"))
    query, _ = written(named.join(bounded(asked, FEW), "doc", "left_semi"))

    def bands_of(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.select(*columns, *CLASS, F.explode(F.arrays_zip(*DIGEST)).alias("b")).select(*columns, *CLASS, "b.h", "b.g")

    left, _ = written(bands_of(query.groupBy(*CLASS).agg(*(F.first(c).alias(c) for c in DIGEST))))
    hashes, _ = written(left.select("h").distinct())
    index, _ = written(bands_of(named, "doc").join(bounded(hashes, KNOWN), "h", "left_semi"))
    right, _ = written(index.select(*CLASS, *DIGEST).distinct())
    left, right = dealt(left.withColumnsRenamed({"c": "query_c", "d": "query_d"}), right, DIGEST)
    pairs, _ = written(left.join(right, [*DIGEST, "_l", "_r"]).select("query_c", "query_d", *CLASS).distinct())
    asking = query.select(F.col("doc").alias("query_doc"), F.col("c").alias("query_c"), F.col("d").alias("query_d"))
    found, _ = written(asking.join(pairs, ["query_c", "query_d"]).select("query_doc", *CLASS))
    members, _ = written(index.select(*CLASS, "doc").distinct().join(pairs.select(*CLASS).distinct(), CLASS, "left_semi"))
    return found, members


def candidates_of_digests(asked: DataFrame, digests: DataFrame) -> DataFrame:
    """``query_doc, doc``: what ``candidate_classes`` finds, pair by pair."""
    left, right = dealt(*candidate_classes(asked, digests), CLASS)
    return left.join(right, [*CLASS, "_l", "_r"]).select("query_doc", "doc")


def candidates(query: DataFrame, index: DataFrame, keys: list[str] = ["hashtable", "value"]) -> DataFrame:  # noqa: B006
    """``query_doc, doc``: indexed items that share a band with a query item, each pair once."""
    left, right = dealt(query.select(F.col("doc").alias("query_doc"), *keys), index.select("doc", *keys), keys)
    return left.join(right, [*keys, "_l", "_r"]).select("query_doc", "doc").distinct()


def buckets(bands: DataFrame) -> DataFrame:
    """``hashtable, value, doc`` of bands that at least two items share: one row per member, however many there are."""
    shared = bands.groupBy("hashtable", "value").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return bands.join(shared, ["hashtable", "value"], "left_semi").select("hashtable", "value", "doc")


def buckets_of_bags(packed: DataFrame, samples: int, tables: int, size: int) -> DataFrame:
    """What ``buckets`` makes of the bands of ``packed`` bags (``wmh.packed``, a table: it is read twice), without moving
    or keeping the values of bands that nobody shares.

    Every band travels as a hash of 64 bits.  Documents with a hash that others have too are signed again for these bands,
    and equal bands are told by hashes of 128 bits.
    """
    marked = wmh.digests(packed, samples, tables, size).withColumn("n", F.count("*").over(Window.partitionBy("h"))).where("n > 1")
    only, _ = written(marked.groupBy("doc").agg(F.collect_list("hashtable").alias("only")))
    found, _ = written(wmh.bands_of_packed(packed.join(bounded(only, FEW), "doc"), samples, tables, size))
    single = cut(found.groupBy("h", "g").agg(F.count("*").alias("n")).where("n = 1").select("h", "g"))  # bands that shared 64 bits by chance
    found = found if single.isEmpty() else found.join(single, ["h", "g"], "left_anti")
    return found.select("hashtable", "value", "doc")


def bucket_weights(members: DataFrame) -> DataFrame:
    return members.groupBy("hashtable", "value").agg(F.count("*").alias("weight"))


def star_edges(members: DataFrame) -> DataFrame:
    """``u, v``: each member of a bucket with the bucket's smallest, which keeps components and grows with the members."""
    first = members.groupBy("hashtable", "value").agg(F.min("doc").alias("u"))
    return members.join(first, ["hashtable", "value"]).where("doc <> u").select("u", F.col("doc").alias("v")).distinct()


def linear_edges(members: DataFrame) -> DataFrame:
    """Edges of the bipartite graph element - bucket, with the bucket's size as weight."""
    return members.join(bucket_weights(members), ["hashtable", "value"]).select("doc", "hashtable", "value", "weight")


def members_of_digests(digests: DataFrame) -> DataFrame:
    """``h, g, doc`` of bands that at least two items share, from ``wmh.digests_in_rows``: buckets without their values."""
    bands = digests.select("doc", F.explode(F.arrays_zip(*DIGEST)).alias("b")).select("b.h", "b.g", "doc")
    return bands.withColumn("n", F.count("*").over(Window.partitionBy("h", "g"))).where("n > 1").drop("n")


def quadratic_edges(members: DataFrame, keys: list[str] = ["hashtable", "value"]) -> DataFrame:  # noqa: B006
    """``a, b, bands`` for all pairs in a bucket: grows with the square of a bucket, for small reports only."""
    left, right = dealt(members.select(*keys, F.col("doc").alias("a")), members.select(*keys, F.col("doc").alias("b")), keys)
    return left.join(right, [*keys, "_l", "_r"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("bands"))


def band_parameters(threshold: float, samples: int, false_positive: float = 0.5, false_negative: float = 0.5) -> tuple[int, int]:
    """Number of tables and band size with the least weighted area of false positives and negatives around a threshold.

    The areas are Gauss-Legendre integrals of the chance that items of similarity s share a band.
    """
    nodes, weights = np.polynomial.legendre.leggauss(200)
    low, high = (nodes + 1) / 2 * threshold, threshold + (nodes + 1) / 2 * (1 - threshold)
    found = []
    for tables in range(1, samples + 1):
        for size in range(1, samples // tables + 1):
            miss = lambda s: (1 - s**size) ** tables  # noqa: B023, E731
            error = false_positive * threshold / 2 * (weights * (1 - miss(low))).sum() + false_negative * (1 - threshold) / 2 * (weights * miss(high)).sum()
            found.append((error, tables, size))
    return min(found, key=lambda f: f[0])[1:]


def best_bands(cases: DataFrame, false_positive: float = 0.5, false_negative: float = 0.5, steps: int = 256) -> DataFrame:
    """``threshold, samples, tables, band`` for every different case of ``threshold`` (0 to 1) and ``samples``.

    The choice of ``band_parameters`` as column expressions: every split of the samples is a row, its areas are midpoint sums.
    Of splits that are equal to twelve digits the one with the fewest tables wins.  Cases with nulls, without samples or
    with a threshold out of range have no row.
    """
    fit = F.col("threshold").between(0, 1) & (F.col("samples") >= 1)
    splits = cases.select(F.col("threshold").cast("double"), F.col("samples").cast("int")).where(fit).distinct()
    splits = splits.select("*", F.explode(F.sequence(F.lit(1), "samples")).alias("tables"))
    splits = splits.select("*", F.explode(F.sequence(F.lit(1), F.floor(F.col("samples") / F.col("tables")).cast("int"))).alias("band"))

    def area(low, width, chance):
        at = lambda i: low + width * (i + 0.5) / steps
        miss = lambda s: F.pow(1 - F.pow(s, F.col("band")), F.col("tables"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(0.0), lambda sum_, i: sum_ + chance(miss(at(i)))) * width / steps

    t = F.col("threshold")
    error = false_positive * area(F.lit(0.0), t, lambda miss: 1 - miss) + false_negative * area(t, 1 - t, lambda miss: miss)
    best = splits.groupBy("threshold", "samples").agg(F.min(F.struct(F.round(error, 12).alias("error"), "tables", "band")).alias("best"))
    return best.select("threshold", "samples", "best.tables", "best.band")
