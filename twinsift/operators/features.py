"""Weighted feature bags of items (doc, text): rows ``feature, doc, weight``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.config import Mode
from twinsift.functions.stemming import stems
from twinsift.sources import trees
from twinsift.sources.files import text_of

IDENTIFIER = "[A-Z]?[a-z]+|[A-Z]+"
LITERAL = r'[0-9]+(?:\.[0-9]+)?|"[^"\n]*"'


def _counted(names: Column, weight: int) -> Column:
    """The different ones of ``names``, sorted, as ``feature`` and ``n`` times ``weight``; ``names`` must be a sorted column."""
    at = lambda i: F.get(names, i - 1)
    firsts = F.filter(F.sequence(F.lit(1), F.size(names)), lambda i: (i == 1) | (at(i) != at(i - 1)))
    firsts = F.when(F.size(names) > 0, firsts).otherwise(F.array().cast("array<int>"))
    # Each name with its first place, then with the next name's first place.
    begins = F.transform(firsts, lambda i: F.struct(at(i).alias("feature"), i.alias("i")))
    ends = F.concat(F.slice(firsts, 2, F.greatest(F.size(names), F.lit(1))), F.array(F.size(names) + 1))
    return F.zip_with(begins, F.slice(ends, F.lit(1), F.size(firsts)), lambda f, e: F.struct(f["feature"].alias("feature"), ((e - f["i"]) * weight).cast("long").alias("weight")))


def _bag(items: DataFrame, found: list[tuple[Column, int]]) -> DataFrame:
    """``feature, doc, weight``: for each pair of ``found`` the names of an item, counted, times a weight.

    An item is one row and is counted where it lies: no name is shuffled, and no task holds more than an item.
    """
    items, bag = _in_row(items, found)
    return items.select("doc", F.explode(bag).alias("f")).select("f.feature", "doc", "f.weight")


def _in_row(items: DataFrame, found: list[tuple[Column, int]]) -> tuple[DataFrame, Column]:
    items, names = _as_columns(items, [F.sort_array(names) for names, _ in found])
    bags = [_counted(n, weight) for n, (_, weight) in zip(names, found)]
    return items, F.concat(*bags) if len(bags) > 1 else bags[0]


def _as_columns(items: DataFrame, names: list[Column]) -> tuple[DataFrame, list[Column]]:
    """``items`` with ``names`` as columns, made once."""
    # Arrays of one row each: an optimiser that put them into the expressions over it would make (and sort) them for every name.
    for i, n in enumerate(names):
        items = items.select("*", F.explode(F.array(n)).alias(f"_names{i}"))
    return items, [F.col(f"_names{i}") for i in range(len(names))]


def _identifiers(stem: bool) -> Column:
    parts = F.transform(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0)), F.lower)
    return F.transform(stems(parts) if stem else parts, lambda p: F.concat(F.lit("i."), p))


def _literals() -> Column:
    return F.transform(F.regexp_extract_all("text", F.lit(LITERAL), F.lit(0)), lambda p: F.concat(F.lit("l."), F.substring(F.md5(p), 1, 16)))


def identifiers(items: DataFrame, weight: int = 1, stem: bool = False) -> DataFrame:
    """``i.`` and the lower-case parts of camel- or snake-case words; the weight is a multiple of their number.

    ``stem``: parts of over six letters count as their stems.
    """
    return _bag(items.select("doc", "text"), [(_identifiers(stem), weight)])


def literals(items: DataFrame, weight: int = 1) -> DataFrame:
    """``l.`` and 16 hex digits of the hash of each number or quoted string."""
    return _bag(items.select("doc", "text"), [(_literals(), weight)])


def _runs(lengths: tuple[int, ...], stride: int) -> Column:
    """Runs of the array ``w``, of every length, one every ``stride`` places."""

    def of_length(n: int) -> Column:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n, F.lit(stride))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit("s."), *[c for j in range(n) for c in (F.lit(">"), F.get("w", i + j))][1:]))

    return F.concat(*[of_length(n) for n in lengths])


def sequences(items: DataFrame, weight: int = 1, lengths: tuple[int, ...] = (3,), stride: int = 1) -> DataFrame:
    """``s.`` and runs of words joined by ``>``, one run every ``stride`` words, for items that have no tree."""
    return _bag(_with_words(items.select("doc", "text")), [(_runs(lengths, stride), weight)])


def _with_words(items: DataFrame) -> DataFrame:
    return items.select("*", F.explode(F.array(F.array_remove(F.split(F.lower("text"), "[^a-z]+", -1), ""))).alias("w"))


def tree_sequences(nodes: DataFrame, weight: int = 1, lengths: tuple[int, ...] = (3,), stride: int = 1) -> DataFrame:
    """``s.`` and runs of node types joined by ``>``, in the order in which a walk down the tree meets them."""
    walked = nodes.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "internal_type"))), lambda n: n["internal_type"]).alias("w"))
    return _bag(walked, [(_runs(lengths, stride), weight)])


def graphlets(nodes: DataFrame, weight: int = 1) -> DataFrame:
    """``g.`` parent, node and sorted children types joined by ``_`` for every node of (doc, node_id, parent_id, internal_type)."""
    parent = nodes.select("doc", F.col("node_id").alias("parent_id"), F.col("internal_type").alias("parent_type"))
    children = nodes.where("parent_id is not null").groupBy("doc", F.col("parent_id").alias("node_id")).agg(F.sort_array(F.collect_list("internal_type")).alias("kids"))
    # Spark takes nodes for as large as the files they were parsed from, and would send all of them through the driver.
    around = nodes.join(parent.hint("merge"), ["doc", "parent_id"], "left").join(children.hint("merge"), ["doc", "node_id"], "left")
    parts = F.concat(F.array(F.coalesce("parent_type", F.lit("None")), F.col("internal_type")), F.coalesce("kids", F.array().cast("array<string>")))
    named = around.select("doc", F.concat(F.lit("g."), F.array_join(parts, "_")).alias("feature"))
    return named.groupBy("feature", "doc").agg((F.count("*") * weight).alias("weight"))


#: Extractors by name: each takes a mode and gives names of a row of items (``text``; its words are ``w``) and their weight; others may be added.
EXTRACTORS: dict[str, Callable[[Mode], tuple[Column, int] | None]] = {
    "identifiers": lambda m: (_identifiers(m.stem), m.identifiers),
    "literals": lambda m: None if m.literals is None else (_literals(), m.literals),
    "sequences": lambda m: None if m.sequences is None else (_runs(m.sequence_lengths, m.sequence_stride), m.sequences),
}


#: Extractors of items that have a tree: each takes (nodes, mode), nodes as ``doc, node_id, parent_id, internal_type``.
TREE_EXTRACTORS: dict[str, Callable[[DataFrame, Mode], DataFrame | None]] = {
    "graphlets": lambda nodes, m: graphlets(nodes, m.graphlet),
    "sequences": lambda nodes, m: None if m.sequences is None else tree_sequences(nodes, m.sequences, m.sequence_lengths, m.sequence_stride),
}


def _found(mode: Mode) -> list[tuple[Column, int]]:
    return [f for f in (e(mode) for e in EXTRACTORS.values()) if f is not None]


def counted(items: DataFrame, mode: Mode) -> DataFrame:
    """``items`` (a row each) with ``f``: the features that ``extract`` finds without trees, with their weights, in the item's row."""
    rows, bag = _in_row(_with_words(items) if mode.sequences is not None else items, _found(mode))
    return rows.select(*items.columns, F.explode(F.array(bag)).alias("f"))


def distinct_hashes(items: DataFrame, mode: Mode) -> DataFrame:
    """``items`` with ``hs``: 64-bit hashes of the different features that ``counted`` finds."""
    rows = _with_words(items) if mode.sequences is not None else items
    hashes = [F.array_distinct(F.transform(names, lambda p: F.xxhash64(p))) for names, _ in _found(mode)]
    return rows.select(*items.columns, F.concat(*hashes).alias("hs"))


def hashed(items: DataFrame, mode: Mode) -> DataFrame:
    """``items`` with the names that ``counted`` counts, repeats included: their 64-bit hashes as ``hs``, the first four bytes of their
    MD5 as ``ms``, and in ``ns`` how many of them each pair of ``weights`` has, in its order.
    """
    rows, names = _as_columns(_with_words(items) if mode.sequences is not None else items, [names for names, _ in _found(mode)])
    joined = lambda f: F.concat(*[F.transform(n, f) for n in names])
    md5 = joined(lambda p: F.unhex(F.substring(F.md5(p), 1, 8)))
    return rows.select(*items.columns, joined(lambda p: F.xxhash64(p)).alias("hs"), md5.alias("ms"), F.array(*[F.size(n) for n in names]).alias("ns"))


def weights(mode: Mode) -> list[int]:
    """What a name of each extractor of a mode weighs."""
    return [weight for _, weight in _found(mode)]


def extract(items: DataFrame, mode: Mode, nodes: DataFrame | None = None) -> DataFrame:
    """All features of ``items`` (a row each) in a mode; names of different extractors never meet.

    Items with a tree (their doc occurs in ``nodes``) have graphlets, and sequences of node types in place of words.  Without
    ``nodes`` each feature of an item is one row; with them, two functions of one name in a line have a row each.
    """
    def made(items: DataFrame, names: list[str]) -> DataFrame | None:
        found = [f for f in (EXTRACTORS[n](mode) for n in names) if f is not None]
        rows = items.select("doc", "text")
        return _bag(_with_words(rows) if "sequences" in names and mode.sequences is not None else rows, found) if found else None

    if nodes is None:
        return frequent(made(items, list(EXTRACTORS)), mode.least_docs)
    plain = items.join(nodes.select("doc").distinct(), "doc", "left_anti")
    parts = [made(items, [n for n in EXTRACTORS if n != "sequences"]), made(plain, ["sequences"]), *(e(nodes, mode) for e in TREE_EXTRACTORS.values())]
    parts = [f for f in parts if f is not None]
    out = parts[0]
    for f in parts[1:]:
        out = out.unionByName(f)
    return frequent(out, mode.least_docs)


def frequent(features: DataFrame, threshold: int) -> DataFrame:
    """Without features that fewer than ``threshold`` documents have, whatever their weight."""
    if threshold <= 1:
        return features
    common = features.groupBy("feature").agg(F.countDistinct("doc").alias("df")).where(F.col("df") >= threshold).select("feature")
    return features.join(common, "feature", "left_semi")


def line_items(files: DataFrame) -> DataFrame:
    """Items in function mode of prose, which has no functions: its lines with a word, named by their first; doc is ``blob_name:line``."""
    lines = files.select("repository_id", "commit_hash", "path", "blob_id", F.posexplode(F.split(text_of(), "\n", -1)).alias("i", "text"))
    named = lines.where(F.col("text").rlike("[a-z]")).withColumn("fn_line", (F.col("i") + 1).cast("int"))
    name = F.regexp_extract(F.lower("text"), "[a-z]+", 0)
    return named.select("repository_id", "commit_hash", "path", "blob_id", name.alias("fn_name"), "fn_line", "text",
                        trees.function_doc(F.col("blob_id"), name, F.col("fn_line")).alias("doc"))


def function_items(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Items in function mode of source files with ``nodes``: their outermost functions; doc is ``blob_name:line``."""
    text = F.substring(text_of(), F.col("start_at") + 1, F.col("end_at") - F.col("start_at"))
    found = files.join(trees.functions_of(nodes).withColumnRenamed("doc", "blob_id"), "blob_id")
    return found.select("repository_id", "commit_hash", "path", "blob_id", "fn_name", "fn_line", text.alias("text"),
                        trees.function_doc(F.col("blob_id"), F.col("fn_name"), F.col("fn_line")).alias("doc"))


def file_items(files: DataFrame) -> DataFrame:
    return files.select("repository_id", "commit_hash", "path", "blob_id", text_of().alias("text"), F.col("blob_id").alias("doc"))
