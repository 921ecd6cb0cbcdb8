"""The three jobs: hash a collection into the store, query it, report on it."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.config import Mode
from twinsift.functions.formatting import split_func_item
from twinsift.lineage import cut, written
from twinsift.operators import communities, counting, docfreq, features, lsh, report, wmh
from twinsift.operators.components import connected_components
from twinsift.sources import files as sources
from twinsift.sources import trees
from twinsift.sources.store import Store

log = logging.getLogger(__name__)


def chosen_files(files: DataFrame, mode: Mode) -> DataFrame:
    return sources.similarity_candidates(sources.readable(files), mode.min_size)


def nodes_of(files: DataFrame, mode: Mode) -> DataFrame:
    """The trees of the files that a mode looks at, parsed once; how many gave none goes to the log."""
    nodes, seen = trees.observed(trees.nodes_of(chosen_files(files, mode)))
    nodes, _ = written(nodes)  # columns of names and kinds shrink in a table; a checkpoint would keep whole rows
    if seen.get["failed"]:
        log.warning("files without a tree: %s", seen.get)
    return nodes


def items_of(files: DataFrame, mode: Mode, nodes: DataFrame | None = None) -> DataFrame:
    """The items a mode hashes: ``repository_id, commit_hash, path, blob_id, fn_name, fn_line, text, doc``.

    In function mode these are the functions of files in a language with a parser, and the lines of prose; files in other
    programming languages have none.  Files in a language with a parser that have no tree among ``nodes`` are left out:
    without ``nodes`` all of them.
    """
    chosen, code = chosen_files(files, mode), trees.parsed()
    sound = None if nodes is None else chosen.where(code).join(nodes.where("node_id = 0").select(F.col("doc").alias("blob_id")), "blob_id", "left_semi")
    plain = chosen.where(~code)
    if mode.name == "func":
        lines = features.line_items(plain.where(~F.col("lang").isin(sorted(set(sources.LANGUAGES.values())))))
        return lines if sound is None else lines.unionByName(features.function_items(sound, nodes))
    whole = features.file_items(plain if sound is None else plain.unionByName(sound))
    return whole.withColumns({"fn_name": F.lit(None).cast("string"), "fn_line": F.lit(None).cast("int")})


def features_of(items: DataFrame, mode: Mode, nodes: DataFrame) -> DataFrame:
    """Features of ``items``, those of their trees included."""
    return features.extract(items, mode, trees.item_nodes(nodes, mode.name == "func"))


def bands_of(bags: DataFrame, mode: Mode) -> DataFrame:
    return bands_of_rows(wmh.packed(bags), mode)


def bands_of_rows(rows: DataFrame, mode: Mode) -> DataFrame:
    """Bands of bags that are a row each."""
    return wmh.bands_of_packed(rows, mode.samples, mode.tables, mode.band)


def members_of(bags: DataFrame, mode: Mode) -> DataFrame:
    """``hashtable, value, doc`` of the bands of ``bags`` that at least two items share, as a table."""
    return members_of_rows(wmh.packed(bags), mode)


def members_of_rows(rows: DataFrame, mode: Mode) -> DataFrame:
    return lsh.buckets_of_bags(written(rows)[0], mode.samples, mode.tables, mode.band)


def hash_files(files: DataFrame, store: Store, mode: Mode, replace: bool = False) -> None:
    """Places, frequencies and bands of ``files`` into the store, as one job: all of them or, if it fails, none."""
    store.ready_for(mode.name, replace)
    with store.job() as job:
        if replace:
            job.clean(mode.name)
        nodes = nodes_of(files, mode)
        items = items_of(files, mode, nodes)
        found = cut(features_of(items, mode, nodes))
        docs, freq = docfreq.count_docs(items), docfreq.doc_freq(found)
        if log.isEnabledFor(logging.INFO):
            log.info("files to write: %s", counting.approximate_count(sources.readable(files)))
        job.save_meta(sources.meta(sources.readable(files)))
        job.save_docfreq(docs, freq, mode.name)
        job.save_bands(bands_of(docfreq.bags(found, freq, docs), mode), mode.name)


def items_in_store(docs: DataFrame, mode: Mode) -> DataFrame:
    """``doc, blob_id, fn_name, fn_line`` of stored items (column doc), read off their names."""
    part, of_func = split_func_item(F.col("doc")), F.lit(mode.name == "func")
    return docs.select(
        "doc", F.when(of_func, part["sha"]).otherwise(F.col("doc")).alias("blob_id"),
        F.when(of_func, part["fn_name"]).alias("fn_name"), F.when(of_func, part["fn_line"]).alias("fn_line"),
    )


def query_files(files: DataFrame, store: Store, mode: Mode, function: tuple[str, int] | None = None, model: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Duplicates (by content, whatever the filters) and similar items of a batch of query files.

    ``function``: only items of that name and line ask, in function mode.  ``model``: document frequencies (docs, freq)
    in place of the store's; with neither there is no similarity query, and a warning.
    """
    meta = store.read("meta")
    dup = report.find_by_hash(files.select(F.col("blob_id").alias("sha1")), meta)
    model = model or store.docfreq(mode.name)
    if model is None:
        log.warning("no document frequencies of mode %s: similarity query skipped", mode.name)
        empty = "query_doc string, repo string, commit string, path string, sha1 string, fn_name string, fn_line int"
        return dup, store.spark.createDataFrame([], empty)
    nodes = nodes_of(files, mode)
    items = items_of(files, mode, nodes)
    if function is not None:
        items = items.where((F.col("fn_name") == function[0]) & (F.col("fn_line") == function[1]))
    found = features_of(items, mode, nodes).join(items.select("doc").distinct(), "doc", "left_semi")
    bands = bands_of(docfreq.bags(found, model[1], model[0]), mode)
    found = lsh.candidates(bands, store.bands(mode.name))
    known = items_in_store(found.select("doc").distinct(), mode)
    return dup, report.similar(found, known, meta, items, drop_equal=mode.name == "file")


def report_groups(store: Store, mode: Mode) -> tuple[DataFrame, DataFrame]:
    """``node, component`` and ``community, element`` over the store's buckets."""
    members = cut(lsh.buckets(store.bands(mode.name)))
    components = cut(connected_components(lsh.star_edges(members)))
    return components, communities.communities(lsh.linear_edges(members), components)


def report_places(groups: DataFrame, store: Store, mode: Mode) -> DataFrame:
    """Communities of over one element with the places of their elements, as links."""
    return report.group_report(groups, items_in_store(groups.select(F.col("element").alias("doc")).distinct(), mode), store.read("meta"), per_content=mode.name == "func")
