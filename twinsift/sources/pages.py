"""HTML pages as trees of nodes."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.sources.trees import ROWS, last_ids

NODES = "doc string, node_id long, parent_id long, depth int, ord int, internal_type string, token string, roles array<string>, last_id long"
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64()]
PAGES = 100  # that are read at a time
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows: list[list] = []
        self.path: list[int] = []
        self.children: dict[int, int] = {}
        self._add("document", "")

    def _add(self, kind: str, token: str) -> None:
        parent = self.path[-1] if self.path else None
        order = self.children.get(parent, 0) if parent is not None else 0
        if parent is not None:
            self.children[parent] = order + 1
        self.rows.append([len(self.rows), parent, len(self.path), order, kind, token, ["Literal"] if kind == "text" else ["Element"]])
        if kind != "text":
            self.path.append(len(self.rows) - 1)

    def handle_starttag(self, tag, attrs):
        self._add(tag, "")
        if tag in VOID:
            self.path.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.path) - 1, 0, -1):
            if self.rows[self.path[i]][4] == tag:
                del self.path[i:]
                return

    def handle_data(self, data):
        if data.strip():
            self._add("text", data.strip())


def _batch_of(rows: list[list]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], [c.split()[0] for c in NODES.split(", ")])


def nodes(pages: DataFrame) -> DataFrame:
    """A row per node of each page, in the order of the text; a page that does not parse has its nodes up to there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        for batch in batches:
            for i in range(0, len(batch), PAGES):
                for doc, html in zip(*(c.to_pylist() for c in batch.slice(i, PAGES).columns)):
                    tree = _Tree()
                    try:
                        tree.feed(html or "")
                        tree.close()  # the parser holds back an end that may be half a reference
                    except AssertionError:  # html.parser on broken declarations
                        pass
                    out += [[doc, *r, last] for r, last in zip(tree.rows, last_ids([r[1] for r in tree.rows]))]
                    if len(out) >= ROWS:
                        yield _batch_of(out)
                        out = []
        if out:
            yield _batch_of(out)

    return pages.select(F.col("page_id").cast("string").alias("doc"), "html").mapInArrow(run, NODES)
