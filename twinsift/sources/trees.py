"""Source code as tables of nodes, and its functions by intervals of them.

Each file is parsed inside the tasks, in a watched child process: Python by the standard parser, languages of braces by a
scan with a stack.  A file that does not parse, hangs or crashes gives one row with the error and no node, so that a bad
file never stops a job.  What is made of the nodes is made by Spark: nodes are numbered in the order of the text, so a
subtree is an interval of numbers, and outermost functions are intervals that no interval before them covers.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from twinsift.sources import scanner
from twinsift.sources.files import text_of
from twinsift.sources.watched import Failed, Watched

NODES = "doc string, node_id long, parent_id long, ord int, internal_type string, token string, start_line int, start_at int, end_at int, roles array<string>, last_id long, error string"
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int64(), pa.string()]
_NAMES = [c.split()[0] for c in NODES.split(", ")]
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
SECONDS = 30.0  # that a file may take
ROWS = 20_000  # nodes that are handed on at a time
FILES = 100  # texts that are read at a time


def _token(node: ast.AST) -> str | None:
    if isinstance(node, ast.Constant):
        return hex(node.value) if type(node.value) is int else repr(node.value)  # decimal digits of a huge number are an error
    for name in ("name", "id", "attr", "arg", "module"):
        value = getattr(node, name, None)
        if isinstance(value, str):
            return value
    return None


def _roles(node: ast.AST) -> list[str]:
    if isinstance(node, FUNCTIONS):
        return ["Function", "Declaration", "Identifier", "Name"]
    if isinstance(node, ast.Constant):
        return ["Literal"]
    return ["Identifier"] if _token(node) is not None else []


class _Places:
    """Characters by the parser's lines, which end at line feeds and carriage returns alone, and bytes of them."""

    def __init__(self, text: str):
        self.text, self.begins = text, [0, *(m.end() for m in re.finditer(r"\r\n|\r|\n", text))]

    def at(self, line: int, column: int) -> int:
        begin = self.begins[line - 1]
        part = self.text[begin : begin + column]
        return begin + (column if part.isascii() else len(self.text[begin : begin + column].encode()[:column].decode("utf-8", "ignore")))


def python_tree(text: str) -> list[scanner.Node]:
    """Nodes of a Python file in the order of the text; a function begins at its decorators, its line is that of its name."""
    rows: list[scanner.Node] = []
    places = _Places(text)
    stack: list[tuple[ast.AST, int | None, int]] = [(ast.parse(text), None, 0)]
    while stack:
        node, parent, order = stack.pop()
        line, first, last = getattr(node, "lineno", 1), 0, len(text)
        if isinstance(node, FUNCTIONS):
            begin = min([node, *node.decorator_list], key=lambda n: n.lineno)
            sign = begin is not node  # of a decorator
            first, last = places.at(begin.lineno, begin.col_offset) - sign, places.at(node.end_lineno, node.end_col_offset)
        elif hasattr(node, "lineno"):
            first, last = places.at(node.lineno, node.col_offset), places.at(node.end_lineno, node.end_col_offset)
        number = len(rows)
        rows.append(scanner.Node(number, parent, order, type(node).__name__, _token(node), line, first, last, _roles(node)))
        children = [c for c in ast.iter_child_nodes(node) if not isinstance(c, (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop))]
        stack += [(c, number, i) for i, c in reversed(list(enumerate(children)))]
    return rows


#: Parsers by language: each gives the nodes of a text or raises; others may be added.
PARSERS: dict[str, Callable[[str], list[scanner.Node]]] = {"Python": python_tree, **{name: (lambda text, n=name: scanner.nodes(text, n)) for name in scanner.LANGUAGES}}


def parsed(lang: str = "lang") -> Column:
    """Whether a file is in a language that has a parser."""
    return F.coalesce(F.col(lang).isin(list(PARSERS)), F.lit(False))


def nodes_of(files: DataFrame, seconds: float = SECONDS, parsers: dict[str, Callable[[str], list[scanner.Node]]] | None = None, roles: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``NODES`` for each of ``files`` (blob_id, lang, content) in a language that has a parser; doc is the blob_id.

    A null content is an empty file.  A file that gives no tree within ``seconds`` has one row with an error.  ``roles``: of a
    tree only its root and the nodes in one of these roles, for those who look at no others (``functions_of``: ``Function``).
    """
    known, wanted = parsers or PARSERS, frozenset(roles or ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns(lang: str, text: str) -> list[tuple]:
            found = list(zip(*known[lang](text)))
            found.append(last_ids(found[1]))
            if roles is not None:
                kept = [i for i, r in enumerate(found[8]) if not i or not wanted.isdisjoint(r)]
                found = [[c[i] for i in kept] for c in found]
            return found

        parse, rows = Watched(columns, seconds), [[] for _ in _NAMES]

        def parts(least: int) -> Iterator[pa.RecordBatch]:
            while len(rows[0]) >= least:
                yield pa.record_batch([pa.array(c[:ROWS], k) for c, k in zip(rows, _KINDS)], _NAMES)
                for c in rows:
                    del c[:ROWS]

        try:
            for batch in (b.slice(i, FILES) for b in batches for i in range(0, len(b), FILES)):
                for doc, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                    try:
                        cols, error = parse(lang, text), None
                    except Failed as e:
                        cols, error = [[None] for _ in _NAMES[1:-1]], str(e)
                    n = len(cols[0])
                    for all_, new in zip(rows, [[doc] * n, *cols, [error] * n]):
                        all_ += new
                    yield from parts(ROWS)
            yield from parts(1)
        finally:
            parse.close()

    return files.where(F.col("lang").isin(list(known))).select("blob_id", "lang", F.coalesce(text_of(), F.lit("")).alias("text")).mapInArrow(run, NODES)


def observed(nodes: DataFrame) -> tuple[DataFrame, Observation]:
    """``nodes`` with counts that the next action over them makes by the way: files parsed, failed, late and crashed."""
    seen = Observation("trees")
    kind = lambda k: F.count_if(F.col("error").startswith(k))
    return nodes.observe(seen, F.count_if(F.col("node_id") == 0).alias("parsed"), F.count("error").alias("failed"), kind("TimeoutError").alias("late"), kind("Crashed").alias("crashed")), seen


def last_ids(parents: Sequence[int | None]) -> list[int]:
    """The last node of each node's subtree, of a whole tree in the order of the text."""
    last = list(range(len(parents)))
    for i in range(len(parents) - 1, 0, -1):
        if last[i] > last[parents[i]]:
            last[parents[i]] = last[i]
    return last


def intervals(nodes: DataFrame, kept: Column) -> DataFrame:
    """The rows of ``nodes`` (doc, node_id in the order of the text, parent_id, ...) where ``kept``, with ``last_id``: the last node of their subtree.

    For node tables of others, that do not say it.  One sweep over nodes in order with the stack of open ones: a node ends where the next one's parent lies before it.
    Only a path of the tree is held, so a document may have any number of nodes.
    """
    rest = [c for c in nodes.columns if c not in ("doc", "node_id", "parent_id")]
    keep = F.coalesce(kept, F.lit(False))
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(1))
    # Nodes that are not kept travel as three columns: most of a tree is only there to end subtrees.
    rows = nodes.where("node_id is not null").select("doc", "node_id", "parent_id", keep.alias("keep"), F.when(keep, row).alias("row"))
    rows = rows.repartition("doc").sortWithinPartitions("doc", "node_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[tuple[int, int | None, bool, dict | None]] = []  # the open nodes: number, parent, whether kept, other columns
        before, doc, kinds = 0, None, None

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            fixed = [pa.array([r[i] for r in out], t) for i, t in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()), (4, pa.int64()))]
            return pa.record_batch([*fixed[:3], *(pa.array([r[3][c] for r in out], t) for c, t in kinds), fixed[3]], ["doc", "node_id", "parent_id", *rest, "last_id"])

        for batch in batches:
            kinds = kinds or [(f.name, f.type) for f in batch.schema.field("row").type if f.name in rest]
            out: list[tuple] = []
            for d, n, p, k, r in zip(*(c.to_pylist() for c in batch.columns)):
                while path and (d != doc or p is None or path[-1][0] > p):
                    number, parent, is_kept, other = path.pop()
                    if is_kept:
                        out.append((doc, number, parent, other, before))
                path.append((n, p, k, r))
                before, doc = n, d
            if out:
                yield batch_of(out)
        if out := [(doc, number, parent, other, before) for number, parent, is_kept, other in path if is_kept]:
            yield batch_of(out)

    kind = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    return rows.mapInArrow(run, f"doc string, node_id long, parent_id long, {''.join(f'`{c}` {kind[c]}, ' for c in rest)}last_id long")


def outermost(nodes: DataFrame, kind: Column, named: Column) -> DataFrame:
    """The ``nodes`` where ``kind`` that lie in no other such node, with ``last_id`` and ``name``.

    The name joins the tokens of those among the node and its children where ``named``, in order, by ``+``; it is empty
    where there is none.  A child that is of the kind itself names itself alone.
    """
    before = Window.partitionBy("doc").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    spans = nodes.where(kind) if "last_id" in nodes.columns else intervals(nodes, kind)
    found = spans.withColumn("_covered", F.max("last_id").over(before))
    found = found.where("_covered is null or node_id > _covered").drop("_covered")
    tokens = nodes.where(named).select("doc", F.explode(F.when(kind, F.array("node_id")).otherwise(F.array("node_id", "parent_id"))).alias("at"), F.struct("node_id", "token").alias("t")).where("at is not null")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["token"]), "+")
    names = tokens.join(found.select("doc", F.col("node_id").alias("at")), ["doc", "at"], "left_semi").groupBy("doc", F.col("at").alias("node_id")).agg(joined.alias("name"))
    return found.join(names, ["doc", "node_id"], "left").withColumn("name", F.coalesce("name", F.lit("")))


def has_roles(*roles: str) -> Column:
    out = F.lit(True)
    for r in roles:
        out = out & F.array_contains("roles", r)
    return out


def functions_of(nodes: DataFrame) -> DataFrame:
    """Outermost declared functions: ``doc, node_id, last_id, fn_name, fn_line, start_at, end_at``."""
    narrow = nodes.select("doc", "node_id", "parent_id", "token", "start_line", "start_at", "end_at", "roles", "last_id")
    found = outermost(narrow, has_roles("Function", "Declaration"), has_roles("Function", "Identifier", "Name"))
    return found.select("doc", "node_id", "last_id", F.col("name").alias("fn_name"), F.col("start_line").alias("fn_line"), "start_at", "end_at")


def function_doc(blob: Column, name: Column, line: Column) -> Column:
    return F.concat(blob, F.lit("_"), name, F.lit(":"), line.cast("string"))


def item_nodes(nodes: DataFrame, functions: bool) -> DataFrame:
    """``doc, node_id, parent_id, internal_type`` of the trees of whole files, or of their functions."""
    sound = nodes.where("node_id is not null")
    if not functions:
        return sound.select("doc", "node_id", "parent_id", "internal_type", "roles")
    name = function_doc(F.col("doc"), F.col("fn_name"), F.col("fn_line")).alias("item")
    begins = functions_of(nodes).select("doc", "node_id", F.struct("last_id", F.col("node_id").alias("first"), name).alias("f"))
    so_far = Window.partitionBy("doc").orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = sound.join(begins, ["doc", "node_id"], "left").withColumn("f", F.last("f", ignorenulls=True).over(so_far)).where("node_id <= f.last_id")
    parent = F.when(F.col("node_id") != F.col("f.first"), F.col("parent_id"))
    return inside.select(F.col("f.item").alias("doc"), "node_id", parent.alias("parent_id"), "internal_type", "roles")
