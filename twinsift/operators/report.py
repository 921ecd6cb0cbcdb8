"""Duplicate and similarity reports as relations, text and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.functions.formatting import format_url, item_name
from twinsift.lineage import written
from twinsift.operators import lsh


def duplicate_counts(meta: DataFrame) -> DataFrame:
    return meta.groupBy("sha1").agg(F.count("*").alias("n")).where("n > 1")


def duplicates(meta: DataFrame) -> DataFrame:
    """Files whose content occurs more than once, with the number of copies: one row per file."""
    return meta.join(duplicate_counts(meta), "sha1")


def find_by_hash(query: DataFrame, meta: DataFrame) -> DataFrame:
    """All places of the contents asked for (column sha1)."""
    return meta.join(query.select("sha1").distinct(), "sha1")


def similar(candidates: DataFrame, items: DataFrame, meta: DataFrame, query_items: DataFrame, drop_equal: bool) -> DataFrame:
    """Candidates as places: ``query_doc, repo, commit, path, sha1, fn_name, fn_line``.

    File mode leaves out exact copies of the query's own content (``drop_equal``), function mode does not.
    """
    named = candidates.join(items.select("doc", F.col("blob_id").alias("sha1"), "fn_name", "fn_line"), "doc")
    if drop_equal:
        own = query_items.select(F.col("doc").alias("query_doc"), F.col("blob_id").alias("sha1"))
        named = named.join(own, ["query_doc", "sha1"], "left_anti")
    return named.join(meta, "sha1").select("query_doc", "repo", "commit", "path", "sha1", "fn_name", "fn_line")


def similar_of_classes(asking: DataFrame, members: DataFrame, items: DataFrame, meta: DataFrame) -> DataFrame:
    """``similar`` without dropping any, from ``lsh.candidate_classes``: places are found once a class, and rows are made last."""
    key = F.struct(*lsh.CLASS).alias("query_doc")
    places = similar(members.select(key, "doc"), items, meta, members, drop_equal=False)
    places, _ = written(places.select("query_doc.*", *places.columns[1:]))
    left, right = lsh.dealt(asking, places, lsh.CLASS)
    return left.join(right, [*lsh.CLASS, "_l", "_r"]).select("query_doc", *places.columns[2:])


def with_links(rows: DataFrame) -> DataFrame:
    return rows.withColumn("item", item_name(format_url(F.col("repo"), F.col("commit"), F.col("path")), F.col("fn_name"), F.col("fn_line")))


def group_report(groups: DataFrame, items: DataFrame, meta: DataFrame, per_content: bool) -> DataFrame:
    """Places of the members of groups (``community, element``) with over one member.

    ``per_content``: one place per content, the last by (repo, commit, path), as function reports have it.
    """
    large = groups.groupBy("community").agg(F.count("*").alias("n")).where("n > 1").select("community")
    members = groups.join(large, "community", "left_semi").join(items.select(F.col("doc").alias("element"), F.col("blob_id").alias("sha1"), "fn_name", "fn_line"), "element")
    places = meta.groupBy("sha1").agg(F.max(F.struct("repo", "commit", "path")).alias("k")).select("sha1", "k.*") if per_content else meta
    return with_links(members.join(places, "sha1").select("community", "repo", "commit", "path", "sha1", "fn_name", "fn_line"))


def duplicate_text(duplicates: DataFrame) -> DataFrame:
    """One line per duplicate content, and one per place: ``sha1, line_no, line``."""
    rows = duplicates.withColumn("url", format_url(F.col("repo"), F.col("commit"), F.col("path")))
    head = rows.select("sha1", F.lit(0).alias("kind"), F.concat("sha1", F.lit(" ("), F.col("n").cast("string"), F.lit(" duplicates)")).alias("line")).distinct()
    return head.unionByName(rows.select("sha1", F.lit(1).alias("kind"), F.concat(F.lit("  "), "url").alias("line")))


def duplicate_json(duplicates: DataFrame) -> DataFrame:
    """A JSON object per duplicate content: its sha1, the number of copies and the places in order, for contents of few places."""
    rows = duplicates.withColumn("url", format_url(F.col("repo"), F.col("commit"), F.col("path")))
    return rows.groupBy("sha1").agg(F.to_json(F.struct(F.first("sha1").alias("sha"), F.first("n").alias("count"), F.sort_array(F.collect_list("url")).alias("files"))).alias("json"))


def place_json(duplicates: DataFrame) -> DataFrame:
    """A JSON object per place of a duplicate content: a content that any share of the files holds is never gathered in one row."""
    url = format_url(F.col("repo"), F.col("commit"), F.col("path"))
    return duplicates.select("sha1", F.to_json(F.struct(F.col("sha1").alias("sha"), F.col("n").alias("count"), url.alias("file"))).alias("json"))


def group_text(places: DataFrame) -> DataFrame:
    """One line per community of similar items, and one per place: ``community, kind, line``."""
    sizes = places.groupBy("community").agg(F.count("*").alias("n"))
    head = sizes.select("community", F.lit(0).alias("kind"), F.concat("community", F.lit(" ("), F.col("n").cast("string"), F.lit(" similar)")).alias("line"))
    return head.unionByName(places.select("community", F.lit(1).alias("kind"), F.concat(F.lit("  "), "item").alias("line")))


def group_json(places: DataFrame) -> DataFrame:
    """A JSON object per place of a member of a community of similar items."""
    return places.select("community", F.to_json(F.struct("community", "item")).alias("json"))


def duplicate_projects(meta: DataFrame) -> DataFrame:
    """Extension: repositories all of whose contents occur in other repositories too."""
    homes = meta.select("repo", "sha1").distinct()
    elsewhere = homes.groupBy("sha1").agg(F.count("*").alias("repos"))
    return homes.join(elsewhere, "sha1").groupBy("repo").agg(F.count("*").alias("contents"), F.min("repos").alias("least")).where("least > 1").select("repo", "contents")
