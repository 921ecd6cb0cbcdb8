"""The engine's tables: Parquet folders under one keyspace, and manifests that say which folders count.

A job writes folders of its own and then one new manifest; readers take the folders of the last whole manifest.  So a
job is in the store with all its tables or with none: one that dies between two tables leaves folders that nobody reads,
and what it was to replace is still there.  Manifests are numbered and created only where none of that number exists: of
two jobs at a time one is told to begin again.

``meta`` is keyed by all its columns; ``hashtables_<mode>`` is sorted by table and band value, so a lookup reads few row
groups; ``features_docs`` and ``features_freq`` hold a row or rows per mode.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "meta": "sha1 string, repo string, commit string, path string",
    "hashtables_file": "sha1 string, value binary, hashtable int",
    "hashtables_func": "sha1 string, value binary, hashtable int",
    "features_docs": "docs long, id string",
    "features_freq": "feature string, df long, id string",
    "components_file": "element string, component string",
    "components_func": "element string, component string",
    "communities_file": "element string, community string",
    "communities_func": "element string, community string",
}
MANIFESTS = "_manifests"


class NotEmptyError(RuntimeError):
    """The keyspace has rows of the mode and replacing was not asked for."""


class ConflictError(RuntimeError):
    """Another job wrote to the keyspace since this one began."""


@dataclass
class Manifest:
    number: int = 0
    folders: list[dict[str, str]] = field(default_factory=list)  # table, mode ("" for all) and folder
    done: list[str] = field(default_factory=list)  # names of jobs that must not run twice

    def of(self, table: str) -> list[str]:
        return [f["folder"] for f in self.folders if f["table"] == table]


class Job:
    """Writes of one job; they count from ``commit`` on, all at once."""

    def __init__(self, store: Store, name: str | None = None):
        self.store, self.name, self.before = store, name, store.manifest()
        self.new: list[dict[str, str]] = []
        self.dropped: list[dict[str, str]] = []

    @property
    def repeated(self) -> bool:
        """Whether a job of this name is in the store already."""
        return self.name is not None and self.name in self.before.done

    def _add(self, rows: DataFrame, table: str, mode: str = "") -> None:
        folder = f"{table}/{uuid.uuid4().hex}"
        columns = [c.split(" ")[0] for c in SCHEMAS[table].split(", ")]
        rows.select(*columns).write.parquet(self.store.path(folder))
        self.new.append({"table": table, "mode": mode, "folder": folder})

    def _drop(self, table: str, mode: str) -> None:
        self.dropped += [f for f in self.before.folders if f["table"] == table and f["mode"] == mode]

    def save_meta(self, meta: DataFrame) -> None:
        rows = meta.select("sha1", "repo", "commit", "path").dropDuplicates()
        dropped = {f["folder"] for f in self.dropped}
        known = self.store.rows_of("meta", [f for f in self.before.of("meta") if f not in dropped])
        self._add(rows.join(known, ["sha1", "repo", "commit", "path"], "left_anti"), "meta")

    def save_bands(self, bands: DataFrame, mode: str) -> None:
        """``bands``: doc, hashtable, value (hex)."""
        rows = bands.select(F.col("doc").alias("sha1"), F.unhex("value").alias("value"), "hashtable")
        # Ranges of values, not whole tables: there are few tables, however many bands.
        self._add(rows.repartitionByRange("hashtable", "value", "sha1").sortWithinPartitions("hashtable", "value", "sha1"), f"hashtables_{mode}", mode)

    def save_docfreq(self, docs: DataFrame, freq: DataFrame, mode: str) -> None:
        for table, rows in (("features_docs", docs.select("docs")), ("features_freq", freq.select("feature", "df").repartitionByRange("feature").sortWithinPartitions("feature"))):
            self._drop(table, mode)
            self._add(rows.withColumn("id", F.lit(mode)), table, mode)

    def save_groups(self, components: DataFrame, communities: DataFrame, mode: str) -> None:
        """What a report found, a row per element: ``node, component`` and ``community, element``."""
        for table, rows in ((f"components_{mode}", components.withColumnRenamed("node", "element")), (f"communities_{mode}", communities)):
            self._drop(table, mode)
            self._add(rows, table, mode)

    def clean(self, mode: str, purge_meta: bool = False) -> None:
        """Leave out a mode's rows; places in ``meta`` stay unless purged."""
        for table in (f"hashtables_{mode}", f"components_{mode}", f"communities_{mode}", "features_docs", "features_freq"):
            self._drop(table, mode)
        if purge_meta:
            self._drop("meta", "")

    def commit(self) -> None:
        if not (self.new or self.dropped or self.name):
            return
        gone = {f["folder"] for f in self.dropped}
        kept = [f for f in self.before.folders if f["folder"] not in gone] + self.new
        self.store.write(Manifest(self.before.number + 1, kept, self.before.done + [self.name] * (self.name is not None)))
        for folder in gone:
            self.store.delete(folder)


class Store:
    def __init__(self, spark: SparkSession, root: str, keyspace: str = "hashes"):
        self.spark, self.base = spark, f"{root.rstrip('/')}/{keyspace}"

    def path(self, folder: str) -> str:
        return f"{self.base}/{folder}"

    def manifest(self) -> Manifest:
        """The last manifest that is whole; one that a job died in while it wrote it does not count."""
        top = Manifest()
        names = self._names(MANIFESTS)
        for name in sorted(names, reverse=True):
            top.number = max(top.number, int(name.removesuffix(".json")))
            try:
                found = json.loads(self._text(f"{MANIFESTS}/{name}"))
            except ValueError:
                continue
            return Manifest(top.number, found["folders"], found["done"])
        return top

    def write(self, manifest: Manifest) -> None:
        at, fs = self._at(f"{MANIFESTS}/{manifest.number:09d}.json")
        try:
            out = fs.create(at, False)  # only where there is none
        except Exception as e:
            if fs.exists(at):
                raise ConflictError(f"{self.base} was written to by another job") from e
            raise
        out.write(bytearray(json.dumps({"folders": manifest.folders, "done": manifest.done}).encode()))
        out.close()

    @contextmanager
    def job(self, name: str | None = None) -> Iterator[Job]:
        """All writes inside count together when the block ends, none if it raises."""
        job = Job(self, name)
        yield job
        job.commit()

    def rows_of(self, table: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*[self.path(f) for f in folders])

    def read(self, table: str) -> DataFrame:
        """The rows of a table; none if no job wrote it.  A folder that cannot be read is an error, not an empty table."""
        return self.rows_of(table, self.manifest().of(table))

    def bands(self, mode: str) -> DataFrame:
        return self.read(f"hashtables_{mode}").select(F.col("sha1").alias("doc"), "hashtable", F.lower(F.hex("value")).alias("value"))

    def docfreq(self, mode: str) -> tuple[DataFrame, DataFrame] | None:
        docs = self.read("features_docs").where(F.col("id") == mode).select("docs")
        return None if docs.isEmpty() else (docs, self.read("features_freq").where(F.col("id") == mode).select("feature", "df"))

    def save_groups(self, components: DataFrame, communities: DataFrame, mode: str) -> None:
        with self.job() as job:
            job.save_groups(components, communities, mode)

    def is_empty(self, mode: str) -> bool:
        of_mode = [self.read(t).where(F.col("id") == mode) for t in ("features_docs", "features_freq")]
        return all(t.limit(1).isEmpty() for t in [self.read(f"hashtables_{mode}"), *of_mode])

    def clean(self, mode: str, purge_meta: bool = False) -> None:
        with self.job() as job:
            job.clean(mode, purge_meta)

    def vacuum(self) -> None:
        """Delete folders that no manifest lists, and old manifests; only while no job runs."""
        last = self.manifest()
        listed = {f["folder"] for f in last.folders}
        for table in SCHEMAS:
            for name in self._names(table):
                if f"{table}/{name}" not in listed:
                    self.delete(f"{table}/{name}")
        for name in self._names(MANIFESTS):
            if int(name.removesuffix(".json")) < last.number:
                self.delete(f"{MANIFESTS}/{name}")

    def drop(self) -> None:
        self.delete("")

    def ready_for(self, mode: str, replace: bool) -> None:
        """Raises if there are rows of the mode and they are not to be replaced."""
        if not replace and not self.is_empty(mode):
            raise NotEmptyError(f"{self.base} has rows of mode {mode}")

    def _at(self, folder: str) -> tuple[Any, Any]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(folder) if folder else self.base)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at, fs = self._at(folder)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _text(self, folder: str) -> str:
        at, fs = self._at(folder)
        stream = fs.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, folder: str) -> None:
        at, fs = self._at(folder)
        fs.delete(at, True)
