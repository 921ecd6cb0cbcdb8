"""Files of git repositories at their HEAD, read from the repositories' own files on any file system that Spark reads.

Loose objects and packs become one table of objects, a pack in one task; HEAD, branch, commit, tree and blob are joins
over it, and folders are walked one level of all trees a round.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.lineage import cut, written
from twinsift.sources import files

# Fixed values of the formats.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
OFFSET_DELTA, NAME_DELTA = 6, 7
FOLDER, LINK, SUBMODULE = "40000", "120000", "160000"
CACHED = 128 << 20  # bytes of bases of deltas that are held
OUT = 8 << 20  # bytes of objects that are handed on at a time
DEPTH = 3  # folders between the root and a repository's ``.git``, at most; bare repositories lie at any depth
_SMALL = 4096


def _number(data: memoryview, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, lowest first, and where it ends."""
    value = shift = 0
    while True:
        byte = data[at]
        value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at


def _inflate(data: memoryview, at: int) -> tuple[bytes, int]:
    unzip = zlib.decompressobj()
    out = []
    while not unzip.eof:
        piece = data[at : at + 65536]
        if not len(piece):
            raise ValueError("an object has no end")
        out.append(unzip.decompress(piece))
        at += len(piece)
    return b"".join(out), at - len(unzip.unused_data)


def patched(base: bytes, delta: bytes) -> bytes:
    """What a delta makes of its base: runs that are copied from it and runs that the delta holds."""
    view = memoryview(delta)
    size, at = _number(view, 0)
    want, at = _number(view, at)
    if size != len(base):
        raise ValueError("a delta does not fit its base")
    out = []
    while at < len(delta):
        op, at = delta[at], at + 1
        if op & 128:
            where = length = 0
            for i in range(7):
                if op >> i & 1:
                    if i < 4:
                        where |= delta[at] << 8 * i
                    else:
                        length |= delta[at] << 8 * (i - 4)
                    at += 1
            out.append(base[where : where + (length or 65536)])
        else:
            out.append(delta[at : at + op])
            at += op
    found = b"".join(out)
    if len(found) != want:
        raise ValueError("a delta makes an object of another size")
    return found


def _name(kind: str, content: bytes) -> str:
    return hashlib.sha1(f"{kind} {len(content)}\0".encode() + content).hexdigest()


class Pack:
    """The objects of a pack in their order; bases of deltas are worked out again when they no longer fit the cache."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        magic, version, self.count = struct.unpack(">4sII", data[:12])
        if magic != b"PACK" or version not in (2, 3):
            raise ValueError("not a pack")
        self.cache: OrderedDict[int, tuple[str, bytes]] = OrderedDict()
        self.held = 0
        self.by_name: dict[str, int] = {}

    def _head(self, at: int) -> tuple[int, int | str | None, int]:
        """Kind of the entry, its base and where its data begins."""
        begin, byte = at, self.data[at]
        kind, at = byte >> 4 & 7, at + 1
        while byte >= 128:
            byte, at = self.data[at], at + 1
        if kind == OFFSET_DELTA:
            byte, at = self.data[at], at + 1
            back = byte & 127
            while byte >= 128:
                byte, at = self.data[at], at + 1
                back = back + 1 << 7 | byte & 127
            return kind, begin - back, at
        if kind == NAME_DELTA:
            return kind, bytes(self.data[at : at + 20]).hex(), at + 20
        return kind, None, at

    def _keep(self, at: int, found: tuple[str, bytes]) -> None:
        self.cache[at] = found
        self.held += len(found[1])
        while self.held > CACHED and len(self.cache) > 1:
            self.held -= len(self.cache.popitem(last=False)[1][1])

    def read(self, at: int) -> tuple[str, bytes]:
        """The object at a place; a chain of deltas is followed down and then patched up."""
        chain = []
        while at not in self.cache:
            kind, base, begin = self._head(at)
            content, _ = _inflate(self.data, begin)
            if base is None:
                self._keep(at, (KINDS[kind], content))
                break
            chain.append((at, content))
            at = self.by_name[base] if isinstance(base, str) else base
        found = self.cache[at]
        for place, delta in reversed(chain):
            found = (found[0], patched(found[1], delta))
            self._keep(place, found)
        return found

    def __iter__(self) -> Iterator[tuple[str, str, bytes]]:
        """Name, kind and content of each object; those whose base by name comes later follow at the end."""
        at, late = 12, []
        for _ in range(self.count):
            _, base, begin = self._head(at)
            end = _inflate(self.data, begin)[1]
            if isinstance(base, str) and base not in self.by_name:
                late.append(at)
            else:
                yield self._named(at)
            at = end
        while late:
            before, late = late, [p for p in late if self._head(p)[1] not in self.by_name]
            if len(before) == len(late):
                raise ValueError("a delta has no base in its pack")
            for place in before:
                if place not in late:
                    yield self._named(place)

    def _named(self, at: int) -> tuple[str, str, bytes]:
        kind, content = self.read(at)
        name = _name(kind, content)
        self.by_name[name] = at
        return name, kind, content


def _loose(data: bytes) -> Iterator[tuple[str, str, bytes]]:
    whole = zlib.decompress(data)
    head, _, content = whole.partition(b"\0")
    kind = head.split(b" ")[0].decode()
    yield _name(kind, content), kind, content


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A pack or loose object that cannot be read is one row with an error."""
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), (pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()))], ["repository_id", "sha", "kind", "body", "error"])

    for rows in batches:
        for repo, packed, data in zip(*(c.to_pylist() for c in rows.columns)):
            try:
                for name, kind, content in Pack(data) if packed else _loose(data):
                    held.append((repo, name, kind, content, None))
                    size += len(content) + 100
                    if size > OUT:
                        yield batch()
                        held, size = [], 0
            except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                held.append((repo, None, None, None, f"{type(e).__name__}: {e}"))
    if held:
        yield batch()


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of trees: mode, name and object."""
    for rows in batches:
        out = []
        for repo, commit, folder, body in zip(*(c.to_pylist() for c in rows.columns)):
            at = 0
            while at < len(body):
                space, end = body.index(b" ", at), body.index(b"\0", at)
                out.append((repo, commit, folder + body[space + 1 : end].decode("utf-8", "replace"), body[at:space].decode(), body[end + 1 : end + 21].hex()))
                at = end + 21
        names = ["repository_id", "commit_hash", "path", "mode", "sha"]
        yield pa.record_batch([pa.array(c, pa.string()) for c in (zip(*out) if out else [[]] * 5)], names)


def _roots(spark: SparkSession, root: str) -> list[str]:
    """``root`` and patterns of the folders ``.git`` below it, which a listing of ``root`` passes over as hidden."""
    wanted = [root.rstrip("/") + "/*" * depth + "/.git" for depth in range(DEPTH + 1)]
    at = [spark._jvm.org.apache.hadoop.fs.Path(w) for w in wanted]
    fs = at[0].getFileSystem(spark._jsc.hadoopConfiguration())
    return [root, *(w for w, p in zip(wanted, at) if fs.globStatus(p))]


def _placed(spark: SparkSession, root: str, name: str | None, kept: str, filters: Column | None = None) -> DataFrame:
    """``repository_id, at, content`` of the files below ``root`` whose place in their repository is like ``kept``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    raw = (reader.option("pathGlobFilter", name) if name else reader).load(_roots(spark, root))
    raw = raw if filters is None else raw.where(filters)
    pattern = rf"^(.*?)(?:/\.git)?/({kept})$"
    tail = files.below_roots(spark, root)
    rows = raw.where(F.col("path").rlike(f"/(?:{kept})$")).select(tail.alias("tail"), "content")
    rows = rows.select(F.concat(F.lit("/"), "tail").alias("tail"), "content")
    return rows.select(F.substring(F.regexp_extract("tail", pattern, 1), 2, 1 << 30).alias("repository_id"), F.regexp_extract("tail", pattern, 2).alias("at"), "content")


def objects(spark: SparkSession, root: str) -> DataFrame:
    """``repository_id, sha, kind, body, error`` of all objects, loose and packed."""
    loose = _placed(spark, root, "[0-9a-f]" * 38, "objects/[0-9a-f]{2}/[0-9a-f]{38}").select("repository_id", F.lit(False).alias("packed"), "content")
    packs = _placed(spark, root, "pack-*.pack", r"objects/pack/pack-[0-9a-f]+\.pack").select("repository_id", F.lit(True).alias("packed"), "content")
    return loose.unionByName(packs).mapInArrow(_objects, "repository_id string, sha string, kind string, body binary, error string")


def heads(spark: SparkSession, root: str) -> DataFrame:
    """``repository_id, hash``: the commit that HEAD names, itself or by a branch; a loose branch goes before a packed one."""
    text = F.regexp_replace(F.col("content").cast("string"), r"\s+$", "")
    # Only small files are read here: the scan filters by length before it opens a file.
    refs = _placed(spark, root, None, "HEAD|refs/.+", F.col("length") <= _SMALL).select("repository_id", "at", text.alias("text"))
    lines = _placed(spark, root, "packed-refs", "packed-refs").select("repository_id", F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line"))
    packed = lines.where(F.col("line").rlike("^[0-9a-f]{40} ")).select("repository_id", F.substring("line", 42, 1 << 20).alias("at"), F.substring("line", 1, 40).alias("text"), F.lit(1).alias("order"))
    branches = refs.where("at <> 'HEAD'").withColumn("order", F.lit(0)).unionByName(packed).groupBy("repository_id", "at").agg(F.min_by("text", "order").alias("of_branch"))
    named = refs.where("at = 'HEAD'").select("repository_id", F.regexp_extract("text", r"^ref: *(\S+)", 1).alias("at"), "text")
    found = named.join(branches, ["repository_id", "at"], "left").withColumn("hash", F.coalesce("of_branch", "text"))
    return found.where(F.col("hash").rlike("^[0-9a-f]{40}$")).select("repository_id", "hash")


def from_git(spark: SparkSession, root: str) -> DataFrame:
    """The files of every repository below ``root`` (bare, or in a folder ``.git`` at most ``DEPTH`` folders down) at its HEAD, as ``files`` has them.

    A repository is named by its folder below the root.  Empty repositories and HEADs that name no commit give nothing,
    links and submodules are no files, and a pack that cannot be read takes along its own objects alone.
    """
    store, _ = written(objects(spark, root).where("error is null").dropDuplicates(["repository_id", "sha"]))
    of = lambda kind: store.where(F.col("kind") == kind).select("repository_id", "sha", "body")
    commits = heads(spark, root).withColumnRenamed("hash", "sha").join(of("commit"), ["repository_id", "sha"])
    tree = F.regexp_extract(F.col("body").cast("string"), "^tree ([0-9a-f]{40})", 1)
    folders = commits.select("repository_id", F.col("sha").alias("commit_hash"), F.lit("").alias("path"), tree.alias("sha"))
    found = None
    while True:
        inside = folders.join(of("tree"), ["repository_id", "sha"]).select("repository_id", "commit_hash", "path", "body")
        level = cut(inside.mapInArrow(_entries, "repository_id string, commit_hash string, path string, mode string, sha string"))
        plain = level.where(~F.col("mode").isin(FOLDER, LINK, SUBMODULE))
        found = plain if found is None else found.unionByName(plain)
        below = level.where(F.col("mode") == FOLDER)
        if below.isEmpty():
            break
        folders = below.select("repository_id", "commit_hash", F.concat("path", F.lit("/")).alias("path"), "sha")
    placed = found.join(of("blob").withColumnRenamed("body", "content"), ["repository_id", "sha"])
    return files.with_facts(placed.select("repository_id", "commit_hash", "path", "content", files.language(F.col("path")).alias("lang")))
