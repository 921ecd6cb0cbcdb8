"""Row counts within a time limit, from the tasks that have ended by then."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import pyarrow as pa
from pyspark import AccumulatorParam, InheritableThread
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECONDS, CONFIDENCE = 10.0, 0.95
FEWEST = 5  # tasks from which bounds are given


@dataclass(frozen=True)
class Count:
    """``n`` rows, or an estimate between ``low`` and ``high`` (null: no bound known) if not all tasks ended."""

    n: int
    low: int
    high: int | None
    exact: bool

    def __str__(self) -> str:
        return str(self.n) if self.exact else f"about {self.n} ({self.low} to {'any number' if self.high is None else self.high})"


class _Sums(AccumulatorParam):
    """Tasks that have ended, their rows, and the squares of these."""

    def zero(self, value: tuple) -> tuple:
        return (0, 0, 0)

    def addInPlace(self, a: tuple, b: tuple) -> tuple:
        return tuple(x + y for x, y in zip(a, b))


def scaled_up(tasks: int, rows: int, squares: int, partitions: int, confidence: float) -> Count:
    """What the rows of some tasks say of all partitions: the mean times their number, with bounds by Student's t.

    The partitions counted are seen as drawn at random; what they hold is the least that there can be.
    """
    if tasks >= partitions:
        return Count(rows, rows, rows, True)
    n = max(rows, round(rows / tasks * partitions)) if tasks else 0
    if tasks < FEWEST:
        return Count(n, rows, None, False)
    free = tasks - 1
    variance = max(0, tasks * squares - rows * rows) / (tasks * free)
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    t = z + (z**3 + z) / (4 * free) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * free**2)
    off = t * partitions * math.sqrt(variance / tasks * (1 - tasks / partitions))
    return Count(n, min(n, max(rows, math.floor(n - off))), math.ceil(n + off), False)


def approximate_count(df: DataFrame, seconds: float = SECONDS, confidence: float = CONFIDENCE) -> Count:
    """Rows of ``df`` as far as they can be told in so many seconds.

    Every task counts its partition and adds one number to an accumulator.  If all end in time the count is exact; else
    what ended is scaled up to all partitions, and the rest of the job is cancelled.  No column is read but those
    that filters of ``df`` need.  Shuffles below ``df`` run before the clock starts.  A job that fails raises its error.
    """
    if seconds <= 0 or not 0 < confidence < 1:
        raise ValueError(f"a positive time and a confidence between 0 and 1 are needed, not {seconds} and {confidence}")
    context, tag = df.sparkSession.sparkContext, f"approximate-count-{uuid.uuid4()}"
    seen = context.accumulator((0, 0, 0), _Sums())
    failed: list[Exception] = []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array([sum(b.num_rows for b in batches)], pa.int64())], ["n"])

    numbers = df.select(F.lit(True).alias("row")).mapInArrow(count, "n long").rdd
    partitions = numbers.getNumPartitions()

    def run() -> None:
        context.addJobTag(tag)
        try:
            numbers.foreach(lambda r: seen.add((1, r["n"], r["n"] ** 2)))
        except Exception as e:
            failed.append(e)

    job = InheritableThread(target=run, daemon=True)
    job.start()
    job.join(seconds)
    late = job.is_alive()
    while job.is_alive():  # it may not have been submitted yet when it is first cancelled
        context.cancelJobsWithTag(tag)
        job.join(0.5)
    if failed and not late:
        raise failed[0]
    return scaled_up(*seen.value, partitions, confidence)
