"""File relations and their filters.

``files`` has a row per file: repository_id, commit_hash, path, content, blob_id, content_size, is_binary, lang.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.functions.formatting import document_id
from twinsift.functions.hashing import git_blob_sha1
from twinsift.lineage import written

SHARED = 250_000  # contents with copies whose first places every task may hold
#: Paths that hold other people's code.
VENDORED = r"(^|/)(vendor|node_modules|third_party|bower_components|dist)/|(^|/)\.git/|\.min\.js$"
LANGUAGES = {
    "py": "Python", "go": "Go", "java": "Java", "js": "JavaScript", "mjs": "JavaScript", "jsx": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript",
    "scala": "Scala", "kt": "Kotlin", "rb": "Ruby", "c": "C", "h": "C", "cpp": "C++", "cc": "C++", "hpp": "C++", "cs": "C#", "rs": "Rust", "php": "PHP",
    "swift": "Swift", "m": "Objective-C", "sh": "Shell", "bash": "Shell", "pl": "Perl", "lua": "Lua", "r": "R", "jl": "Julia", "hs": "Haskell", "ml": "OCaml",
    "clj": "Clojure", "ex": "Elixir", "erl": "Erlang", "sql": "SQL", "html": "HTML", "css": "CSS",
}


def with_facts(files: DataFrame) -> DataFrame:
    content = F.col("content")
    return files.select(
        "repository_id", "commit_hash", "path", "content",
        git_blob_sha1(content).alias("blob_id"), F.octet_length(content).cast("long").alias("content_size"),
        F.contains(F.substring(content, 1, 8000), F.unhex(F.lit("00"))).alias("is_binary"), "lang",
    )


def from_documents(documents: DataFrame) -> DataFrame:
    """Documents as files: a source is a repository."""
    return with_facts(documents.select(
        F.col("source").alias("repository_id"), F.sha1(F.col("source")).alias("commit_hash"),
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"), "lang",
    ))


def below_roots(spark: SparkSession, root: str) -> Column:
    """The part of a file's path below the root it was found in; ``root`` may be a pattern with several."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    roots = sorted({fs.makeQualified(s.getPath()).toString().rstrip("/") for s in fs.globStatus(at) or []}, key=len, reverse=True)
    if len({r.count("/") for r in roots}) == 1:  # all at one depth: however many they are, one expression does
        return F.array_join(F.slice(F.split("path", "/"), roots[0].count("/") + 2, 1 << 20), "/")
    return F.coalesce(*[F.when(F.col("path").startswith(r + "/"), F.substring("path", len(r) + 2, 1 << 30)) for r in roots], F.lit(""))


def language(path: Column) -> Column:
    """The language that a file's name ends in; null for others."""
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))]


def from_folder(spark: SparkSession, root: str, commit: str = "") -> DataFrame:
    """All files below ``root``, which may be a pattern; the first level below a root names the repository."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    tail = below_roots(spark, root)
    return with_facts(raw.select(
        F.substring_index(tail, "/", 1).alias("repository_id"), F.lit(commit).alias("commit_hash"),
        F.regexp_replace(tail, "^[^/]*/", "").alias("path"), "content", language(F.col("path")).alias("lang"),
    ))


def vendored(path: Column) -> Column:
    return path.rlike(VENDORED)


def readable(files: DataFrame) -> DataFrame:
    """Without binary, vendored and empty files."""
    return files.where(~F.col("is_binary") & ~vendored(F.col("path")) & (F.col("content_size") > 0))


def distinct_blobs(files: DataFrame) -> DataFrame:
    """One file per content: the first by repository and path, nulls last.

    Only keys are grouped.  The firsts of contents that have copies are then known to every task, so that no content moves; over
    ``SHARED`` of them are joined in a shuffle.
    """
    keys = ["repository_id", "path", "commit_hash"]
    order = F.struct(*[c for k in keys for c in (F.col(k).isNull().alias(f"_no_{k}"), F.col(k))], F.col("_n"))
    places = files.groupBy("blob_id", *keys).agg(F.count("*").alias("_n"))
    firsts = places.groupBy("blob_id").agg(F.min(order).alias("_first"), F.sum("_n").alias("_all")).where("_all > 1").drop("_all")
    firsts, _ = written(firsts)
    n, repeated = firsts.agg(F.count("*"), F.count(F.when(F.col("_first._n") > 1, 1))).first()
    if not n:
        return files
    is_first = F.lit(True)
    for k in keys:
        is_first = is_first & F.col(k).eqNullSafe(F.col(f"_first.{k}"))
    chosen = files.join(F.broadcast(firsts) if n <= SHARED else firsts, "blob_id", "left").where(F.col("_first").isNull() | is_first).drop("_first")
    return chosen.dropDuplicates(["blob_id"]) if repeated else chosen  # the same place in several rows


def similarity_candidates(files: DataFrame, min_size: int | None) -> DataFrame:
    """Distinct contents in a known language, in file mode only those over ``min_size`` bytes."""
    known = files.where("lang is not null")
    return distinct_blobs(known if min_size is None else known.where(F.col("content_size") > min_size))


def with_document_id(files: DataFrame) -> DataFrame:
    return files.withColumn("document", document_id(F.col("repository_id"), F.col("path"), F.col("blob_id")))


def meta(files: DataFrame) -> DataFrame:
    """Rows of the meta table: where each content occurs; all four columns are the key."""
    return files.select(F.col("blob_id").alias("sha1"), F.col("repository_id").alias("repo"), F.col("commit_hash").alias("commit"), "path").dropDuplicates()


def list_repositories(files: DataFrame, limit: int = 0) -> DataFrame:
    found = files.select("repository_id").distinct()
    return found.orderBy("repository_id").limit(limit) if limit > 0 else found


def only_repositories(files: DataFrame, repos: DataFrame) -> DataFrame:
    return files.join(repos, "repository_id", "left_semi")


def unique_repositories(heads: DataFrame) -> DataFrame:
    """One repository per HEAD (repository_id, hash): a remote one before a local (empty or ``file://``) one."""
    local = (F.col("repository_id") == "") | F.col("repository_id").startswith("file://")
    return heads.groupBy("hash").agg(F.min(F.struct(local.alias("local"), "repository_id"))["repository_id"].alias("repository_id"))


def text_of(content: str = "content") -> Column:
    """A file's text; bytes that are no UTF-8 are replaced, so a file in another encoding stops no job."""
    return F.make_valid_utf8(F.col(content).cast("string"))


def skip_report(files: DataFrame, min_size: int, nodes: DataFrame | None = None) -> DataFrame:
    """How many files each filter drops: the first that applies counts.  With the ``nodes`` of the files that are left
    (``trees.nodes_of``), those that gave no tree are counted by what went wrong, at each place."""
    reason = (
        F.when(F.col("content_size") == 0, "empty").when(F.col("is_binary"), "binary").when(vendored(F.col("path")), "vendored")
        .when(F.col("lang").isNull(), "no language").when(F.col("content_size") <= min_size, "small")
    )
    if nodes is None:
        return files.groupBy(F.coalesce(reason, F.lit("processed")).alias("reason")).agg(F.count("*").alias("files"))
    failed = nodes.where("error is not null").select(F.col("doc").alias("blob_id"), F.substring_index("error", ":", 1).alias("error")).distinct()
    named = files.withColumn("reason", reason).join(failed, "blob_id", "left")
    return named.groupBy(F.coalesce("reason", F.concat(F.lit("no tree: "), "error"), F.lit("processed")).alias("reason")).agg(F.count("*").alias("files"))
