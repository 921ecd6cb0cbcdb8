"""Exact duplicates by Patricia tries.

Texts are equal when their bytes are, after each run of white space became one space.  Whole texts go into compressed
radix tries: first in the task that reads them, which hands on each different text once with its smallest id and its
number, so that a text that a third of the rows hold arrives as few rows; then in partitions by length and content
hash, where terminal nodes keep the smallest id over all.  A trie that grows over its budget spills its heaviest
subtree: what lies below that prefix, and what comes later, goes through the shared checkpoint folder into another
round.  Rounds end because every task finishes what it still holds.

Documents find their owner by the digest of their text and a salt: an owner goes to the salts that asked for it, at
most ``SALTS``, so that no join key holds a whole group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.lineage import cut
from twinsift.llm.texts import by_bytes, packed

BREAKS = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"  # what is not one space already
SALTS = 64
HANDED = 32 << 20  # bytes of a trie in the task that reads texts, before it hands on what it has
HELD = 96 << 20  # bytes of a trie in a partition, before it spills
NODE = 400  # bytes of a node besides its text, roughly


def normalised(text: str = "text") -> Column:
    """White space shrunk to single spaces, also at the ends; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), BREAKS, " ")


class Node:
    __slots__ = ("edge", "kids", "end", "spilled")

    def __init__(self, edge: bytes, end: Any = None):
        self.edge, self.kids, self.end, self.spilled = edge, {}, end, False


def shared_bytes(edge: bytes, text: bytes, at: int) -> int:
    """How many bytes of ``edge`` agree with ``text`` from ``at``; they do not all.  Bytes are compared in runs, never one by one."""
    low, step = 0, 8
    while step < len(edge) and text.startswith(edge[low:step], at + low):
        low, step = step, step * 2
    high = min(step, len(edge))
    while high - low > 1:
        middle = (low + high) // 2
        if text.startswith(edge[low:middle], at + low):
            low = middle
        else:
            high = middle
    return low


class Trie:
    """A compressed radix trie of byte strings with something at each terminal node."""

    def __init__(self):
        self.root, self.bytes, self.texts = Node(b""), 0, 0

    def find(self, text: bytes, new: Callable[[], Any]) -> Any:
        """What the terminal node of ``text`` has, ``new()`` if it is new here; None below a spilled prefix."""
        node, at = self.root, 0
        while not node.spilled:
            if at == len(text):
                if node.end is None:
                    node.end = new()
                    self.texts += 1
                return node.end
            kid = node.kids.get(text[at])
            if kid is None:
                return self._add(node, text[at:], new)
            if text.startswith(kid.edge, at):
                node, at = kid, at + len(kid.edge)
                continue
            same = shared_bytes(kid.edge, text, at)
            fork = Node(kid.edge[:same])
            node.kids[fork.edge[0]] = fork
            kid.edge = kid.edge[same:]
            fork.kids[kid.edge[0]] = kid
            self.bytes += NODE
            node, at = fork, at + same
        return None

    def _add(self, node: Node, edge: bytes, new: Callable[[], Any]) -> Any:
        node.kids[edge[0]] = kid = Node(edge, new())
        self.bytes += len(edge) + NODE
        self.texts += 1
        return kid.end

    @staticmethod
    def below(top: Node, prefix: bytes = b"") -> Iterator[tuple[bytes, Any]]:
        """Whole texts and what they have, of a subtree whose parent ends at ``prefix``."""
        stack = [(top, prefix)]
        while stack:
            node, before = stack.pop()
            text = before + node.edge
            if node.end is not None:
                yield text, node.end
            stack += [(k, text) for k in node.kids.values()]

    def _weights(self) -> dict[int, int]:
        order, stack = [], [self.root]
        while stack:
            order.append(node := stack.pop())
            stack += node.kids.values()
        weight: dict[int, int] = {}
        for node in reversed(order):
            weight[id(node)] = len(node.edge) + NODE + sum(weight[id(k)] for k in node.kids.values())
        return weight

    def spill(self) -> list[tuple[bytes, Any]]:
        """Cut off the heaviest subtree that holds at most half of the trie (or a leaf that holds more), and give its texts."""
        weight = self._weights()
        node, prefix = self.root, b""
        while True:
            prefix += node.edge
            node = max((k for k in node.kids.values() if not k.spilled), key=lambda k: weight[id(k)])
            if 2 * weight[id(node)] <= weight[id(self.root)] or not any(not k.spilled for k in node.kids.values()):
                break
        out = list(self.below(node, prefix))
        self.bytes -= weight[id(node)] - len(node.edge) - NODE
        self.texts -= len(out)
        node.kids, node.end, node.spilled = {}, None, True
        return out


def _lower(a: Any, b: Any) -> Any:
    """The smaller id; null comes last."""
    return b if a is None else a if b is None or a <= b else b


_COLS = ["length", "hash", "sha", "low", "n", "salts", "text"]


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.binary(), kind, pa.int64(), pa.int64(), pa.binary()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], _COLS)


def _pieces(rows: Iterator[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Batches of about 8 MB of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"") + 100
        if size > 8 << 20:
            yield _batch(held, kind)
            held, size = [], 0
    if held:
        yield _batch(held, kind)


def _insert(trie: Trie, row: tuple) -> bool:
    """Put (length, hash, sha, low, n, salts, text) into a trie; false if it belongs to a spilled subtree."""
    length, key, sha, low, n, salts, text = row
    end = trie.find(text, lambda: [length, key, sha, low, 0, 0])
    if end is None:
        return False
    end[3], end[4], end[5] = _lower(end[3], low), end[4] + n, end[5] | salts
    return True


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    for part in by_bytes(batch, len(_COLS) - 1):
        yield from zip(*(c.to_pylist() for c in part.columns))


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each different text of a task (of a trie's budget of it, where it reads more) once."""
    trie, kind = Trie(), None
    for batch in batches:
        kind = batch.column(3).type
        for row in _rows(batch):
            _insert(trie, row)
            if trie.bytes > HANDED:
                yield from _pieces(((*end, text) for text, end in Trie.below(trie.root)), kind)
                trie = Trie()
    if kind is not None:
        yield from _pieces(((*end, text) for text, end in Trie.below(trie.root)), kind)


def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each different text of a partition without its bytes; with them where its subtree was spilled."""
    trie, kind, late, size = Trie(), None, [], 0
    for batch in batches:
        kind = batch.column(3).type
        for row in _rows(batch):
            before = len(late)
            if not _insert(trie, row):
                late.append(row)
            elif trie.bytes > HELD and trie.texts > 1:
                late += [(*end, text) for text, end in trie.spill()]
            size += sum(len(r[-1]) + NODE for r in late[before:])
            if size > HELD // 4:
                yield from _pieces(iter(late), kind)
                late, size = [], 0
    if kind is not None:
        yield from _pieces(iter(late), kind)
        yield from _pieces(((*end, None) for _, end in Trie.below(trie.root)), kind)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, normalised text, digest and salt of every document."""
    text = docs.select(F.col(id_col).alias("low"), normalised(text_col).alias("text"))
    salt = F.pmod(F.xxhash64("low", F.lit(11)), F.lit(SALTS)).cast("int")
    return text.select("low", "text", F.unhex(F.sha2("text", 256)).alias("sha"), salt.alias("salt"))


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``sha, salt, keep_id, group_size``: each different normalised text, once for every salt that its documents have."""
    keyed = _keyed(docs, id_col, text_col)
    kind = keyed.schema["low"].dataType.simpleString()
    schema = f"length int, hash long, sha binary, low {kind}, n long, salts long, text binary"
    rows = keyed.select(
        F.octet_length("text").alias("length"), F.xxhash64("text").alias("hash"), "sha", "low", F.lit(1).cast("long").alias("n"),
        F.expr("shiftleft(1L, salt)").alias("salts"), F.col("text").cast("binary").alias("text"),
    )
    left, found, rounds = rows.mapInArrow(combine, schema), None, 0
    while True:
        dealt = left.repartition("length", "hash", F.lit(rounds))  # another round deals the spilled texts of a partition out anew
        out = cut(dealt.mapInArrow(own, schema))
        done, left, rounds = out.where("text is null").drop("text"), out.where("text is not null"), rounds + 1
        found = done if found is None else found.unionByName(done)
        if left.isEmpty():
            break
    asked = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("salts", i) == 1)
    return found.select("sha", F.explode(asked).alias("salt"), F.col("low").alias("keep_id"), F.col("n").alias("group_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs``.

    Null and empty texts are equal; a text of white space is one space.  The row with the smallest id of equal texts
    stays; a null id comes last and owns a text only if no row of it has an id.  Rows that share text and id stay or go
    together and are all counted.  An empty table gives an empty result; other columns are ignored.
    """
    asked = _keyed(docs, id_col, text_col).select("low", "sha", "salt")
    found = asked.join(owners(docs, id_col, text_col), ["sha", "salt"])
    kept = F.col("low").eqNullSafe(F.col("keep_id"))
    return found.select(F.col("low").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``exact_duplicates`` keeps."""
    text = normalised(text_col)
    salt = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(SALTS)).cast("int")
    rows = packed(docs, sha=F.unhex(F.sha2(text, 256)), salt=salt, low=F.col(id_col))
    found = rows.join(owners(docs, id_col, text_col), ["sha", "salt"])
    return found.where(F.col("low").eqNullSafe(F.col("keep_id"))).select("row.*")
