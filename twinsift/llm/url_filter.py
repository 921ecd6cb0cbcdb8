"""URL filters as a sort-merge range join.

A rule (host, path prefix, verdict) covers an interval of reversed-host keys: its host and all subdomains lie
next to each other when labels are read from the right.  The urls' sorted keys are cut into ranges, each rule
goes to every range its interval touches, and a sweep over each sorted range keeps the stack of nested hosts
whose intervals are open.  Each host on the stack holds its path prefixes sorted, with links to the prefix that
encloses each, so the longest fitting rule takes one search per open host.

Range ends come from a sample of about ``SAMPLE_PER_RANGE`` keys per range, as for any range-partitioned sort; they
decide balance only, never results.  The key ends in the row's hash, so even one url with a third of all rows is split.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.lineage import shuffle_partitions

RULES = "host string, path string, verdict string"
RANGES_PER_PARTITION = 4
SAMPLE_PER_RANGE = 50
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = "\U0010ffff"


def url_host(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: str = "url") -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the right, each closed by U+0001: a host's key is a prefix of its subdomains' keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "\x01"), F.lit("\x01"))


class _Host:
    """A host whose interval is open, with its rules in order of their paths."""

    def __init__(self, key: str, host: str):
        self.key, self.host = key, host
        self.paths: list[str] = []
        self.verdicts: list[str] = []
        self.outer: list[int] = []  # the rule that encloses each, or -1

    def add(self, path: str, verdict: str) -> None:
        if self.paths and self.paths[-1] == path:
            if verdict == "block":
                self.verdicts[-1] = verdict
            return
        i = len(self.paths) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.outer[i]
        self.paths.append(path)
        self.verdicts.append(verdict)
        self.outer.append(i)

    def longest(self, path: str) -> int:
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.outer[i]
        return i

    def covers(self, host: str) -> bool:
        return host == self.host or host.endswith("." + self.host)


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, key, kind, path), rules before urls; yields the judged urls.

    Ids pass as Arrow values, never as floating-point numbers, whatever nulls stand beside them.
    """
    stack: list[_Host] = []
    current = None
    for batch in batches:
        at_row, rules, verdicts = [], [], []
        cols = [batch.column(n).to_pylist() for n in ("_range", "_key", "_kind", "host", "path", "verdict")]
        for i, (at, key, kind, host, path, verdict) in enumerate(zip(*cols)):
            if at != current:
                current, stack = at, []
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1].key != key:
                    stack.append(_Host(key, host))
                stack[-1].add(path, verdict)
                continue
            best, length = (None, None), -1
            for open_host in reversed(stack):  # the longer host wins a tie
                k = open_host.longest(path)
                if k >= 0 and len(open_host.host) + len(open_host.paths[k]) > length and open_host.covers(host):
                    best, length = (open_host.host + open_host.paths[k], open_host.verdicts[k]), len(open_host.host) + len(open_host.paths[k])
            at_row.append(i)
            rules.append(best[0])
            verdicts.append(best[1])
        kept = batch.select(["_row", "host", "path"]).take(pa.array(at_row, pa.int64()))
        yield pa.record_batch([*kept.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], ["_row", "host", "path", "rule", "verdict"])


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``.

    The fitting rule with the longest host and path together wins, of equally long ones the longer host; of equal
    rules with both verdicts, block.  No fitting rule: null rule and the default verdict.  A null url, or one
    without ``://``, has an empty host and path, which only a rule with an empty host could fit.  Null ids are
    kept, repeated rows are judged one by one, an empty table gives an empty result, further columns are ignored;
    null parts of a rule are empty.
    """
    spark = pages.sparkSession
    n = shuffle_partitions(spark) * RANGES_PER_PARTITION
    urls = pages.select(F.col(id_col).alias("_row"), url_host().alias("host"), url_path().alias("path"))
    urls = urls.withColumn("_key", host_key(F.col("host"))).withColumn("_salt", F.hex(F.xxhash64("_row", F.lit(3))))
    share = min(1.0, n * SAMPLE_PER_RANGE / max(1, pages.count()))
    some = urls.select("_key", "path", "_salt").sample(share, seed=5).collect()
    keys = sorted(tuple(r) for r in some)
    ends = sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []

    @F.pandas_udf("int")
    def range_of(key: pd.Series, path: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(ends, k) for k in zip(key, path, salt)], dtype="int32")

    @F.pandas_udf("array<int>")
    def ranges_of(key: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect_right(ends, (k, "", "")), bisect_right(ends, (k + TOP, "", "")) + 1)) for k in key])

    open_rules = rules.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("host", "path", "verdict")])
    open_rules = open_rules.withColumn("host", F.translate("host", UPPER, LOWER)).withColumn("_key", host_key(F.col("host")))
    left = open_rules.select(F.explode(ranges_of("_key")).alias("_range"), "_key", F.lit(0).alias("_kind"), "host", "path", "verdict", F.lit(None).cast("long").alias("_row"))
    right = urls.select(range_of("_key", "path", "_salt").alias("_range"), "_key", F.lit(1).alias("_kind"), "host", "path", F.lit(None).cast("string").alias("verdict"), F.col("_row").cast("long"))
    both = left.unionByName(right).repartition(n, "_range").sortWithinPartitions("_range", "_key", "_kind", "path")
    judged = both.mapInArrow(sweep, "_row long, host string, path string, rule string, verdict string")
    return judged.select(F.col("_row").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
