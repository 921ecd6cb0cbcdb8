"""Content hashes and byte packing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def git_blob_sha1(content: Column) -> Column:
    """SHA-1 of a blob as git computes it: of ``blob``, the size, a zero byte and the content."""
    raw = content.cast("binary")
    head = F.encode(F.concat(F.lit("blob "), F.octet_length(raw).cast("string")), "UTF-8")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), raw))


def uint32_le(value: Column) -> Column:
    """Eight lower-case hex digits of a number modulo 2**32, lowest byte first."""
    big = F.lower(F.lpad(F.hex(F.pmod(value.cast("long"), F.lit(1 << 32))), 8, "0"))
    return F.concat(*[F.substring(big, i, 2) for i in (7, 5, 3, 1)])


def bytes2hex(value: Column, separator: str = "") -> Column:
    """Lower-case hex of a binary, optionally with a separator between bytes."""
    plain = F.lower(F.hex(value))
    return F.regexp_replace(plain, "(..)(?!$)", f"$1{separator}") if separator else plain


def hash31(text: Column) -> Column:
    """A 31-bit hash of a string: the first 32 bits of its MD5 modulo the prime 2**31 - 1."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.lit((1 << 31) - 1)
