"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

#: A word is a run of code points other than space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BREAKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(c: str = "text") -> Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def word_count(c: str = "text") -> Column:
    """Number of words, 0 for null: each word shrinks to one letter, the breaks go, letters are counted."""
    letters = F.translate(F.regexp_replace(c, WORD, "x"), WORD_BREAKS, "")
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def uniform(*cols: Column | str, seed: int = 0) -> Column:
    """A repeatable number in (0, 1) from a row's values."""
    h = F.pmod(F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols], F.lit(seed)), F.lit(1 << 52))
    return (h.cast("double") + 0.5) / float(1 << 52)


def _hashable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return _hashable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def row_key(df: DataFrame) -> Column:
    """A hash of all columns: rows that differ anywhere, nulls included, have different keys."""
    cols = [F.col(f"`{f.name}`") if _hashable(f.dataType) else F.to_json(F.struct(f"`{f.name}`")) for f in df.schema.fields]
    return F.xxhash64(*cols, F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cols]))


def packed(df: DataFrame, **helpers: Column) -> DataFrame:
    """``row`` (all columns of ``df``) and helper columns, whose names then clash with none of them; ``select("row.*")`` unpacks."""
    return df.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in helpers.items()])


SLICE_BYTES = 8 << 20  # bytes of text whose words are held at a time; a longer text is held alone


def by_bytes(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of the text column each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(first, last - first)
        first = last


@dataclass
class Words:
    """The words of some texts: each different word once, the number of every word in order, and where each text begins."""

    distinct: pa.Array
    codes: np.ndarray
    ends: np.ndarray

    def text(self) -> np.ndarray:
        """Which text each word belongs to."""
        return np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends))


def _sound(words: pa.Array) -> pa.Array:
    """Words as valid UTF-8, as kernels for letters need them: bytes that are none are replaced."""
    try:
        words.validate(full=True)
    except pa.ArrowInvalid:
        return pa.array([w.decode("utf-8", "replace") for w in words.cast(pa.binary()).to_pylist()], pa.string())
    return words


def words_of(texts: pa.Array) -> Words:
    """By Arrow kernels; a null text has no words."""
    found = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    real = pc.not_equal(pc.binary_length(found.values), 0)
    encoded = pc.dictionary_encode(found.values.filter(real))
    ends = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))][found.offsets.to_numpy()]
    return Words(_sound(encoded.dictionary), encoded.indices.to_numpy(), ends)

