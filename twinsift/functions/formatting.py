"""Strings that users see: links, item names, query paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERY_PATH = re.compile(r"(.+):(.+):([0-9]+)", re.S)  # path:function:line, for a single path


def format_url(repo: Column, commit: Column, path: Column) -> Column:
    """A link to a file at its host where the host is known, else its three parts."""
    r = F.regexp_replace(repo, r"\.git$", "")
    link = lambda kind: F.concat(F.lit("https://"), r, F.lit(f"/{kind}/"), commit, F.lit("/"), path)
    known = F.when(repo.startswith("github.com") | repo.startswith("gitlab.com"), link("blob")).when(repo.startswith("bitbucket.org"), link("src"))
    return known.otherwise(F.concat(F.lit("repo: "), r, F.lit(" commit: "), commit, F.lit(" path: "), path))


def document_id(repo: Column, path: Column, blob: Column) -> Column:
    return F.concat(repo, F.lit("//"), path, F.lit("@"), blob)


def item_name(url: Column, fn_name: Column, fn_line: Column) -> Column:
    return F.when(fn_line.isNull(), url).otherwise(F.concat(url, F.lit(" function: "), fn_name, F.lit(" line: "), fn_line.cast("string")))


def parse_query_path(path: Column) -> Column:
    """``path:function:line`` or a plain path, as a struct (path, fn_name, fn_line); colons in the path stay there."""
    pattern = r"^(.+):(.+):([0-9]+)$"
    hit = path.rlike(pattern)
    part = lambda i: F.when(hit, F.regexp_extract(path, pattern, i))
    return F.struct(F.when(hit, F.regexp_extract(path, pattern, 1)).otherwise(path).alias("path"), part(2).alias("fn_name"), part(3).cast("int").alias("fn_line"))


def split_func_item(item: Column) -> Column:
    """``sha_name:line`` as a struct (sha, fn_name, fn_line); the sha ends at the first underscore."""
    pattern = r"^([^_]*)_(.*):([0-9]+)$"
    part = lambda i: F.regexp_extract(item, pattern, i)
    return F.struct(part(1).alias("sha"), part(2).alias("fn_name"), part(3).cast("int").alias("fn_line"))
