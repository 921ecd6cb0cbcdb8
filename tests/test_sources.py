import json
import os
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from twinsift import lineage
from twinsift.cli import main
from twinsift.config import FILE, FUNC, mode
from twinsift.operators import communities, features, report
from twinsift.plans import engine
from twinsift.sources import files as sources
from twinsift.sources import pages, scanner, trees
from twinsift.sources.store import SCHEMAS, ConflictError, Job, NotEmptyError, Store
from twinsift.streaming.ingest import ingest


def documents(spark):
    base = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} alpha" for i in range(100))
    rows = [
        (1, base, "en", "r1"), (2, base, "en", "r2"), (3, base + " omega", "en", "r1"), (4, "short", "en", "r1"),
        (5, " ".join(f"other{c}{d} beta" for c in "abcdefghij" for d in "klmnop"), "en", "r3"), (6, None, "en", "r3"), (7, "", "en", "r3"), (8, base + " nolang", None, "r3"),
        (9, " ".join(f"third{c}{d} gamma" for c in "abcdefghij" for d in "uvwxyz"), "en", "r4"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_filters(spark):
    files = sources.from_documents(documents(spark))
    kept = sources.readable(files)
    assert kept.count() == 7
    assert sources.similarity_candidates(kept, FILE.min_size).count() == 4
    assert {r["reason"]: r["files"] for r in sources.skip_report(files.where("content is not null"), 500).collect()} == {"processed": 5, "small": 1, "empty": 1, "no language": 1}
    cases = [(b"a\x00b", "x"), (b"\x10\x01", "y"), (b"p\x00", "x2"), (b"\x10\x01\x00", "x3"), (b"\xff\xfe\xe9\x00", "x4"), (b"a" * 8000 + b"\x00", "y2"), (b"", "y3"), (b"\xe9" * 9, "y4")]
    binary = spark.createDataFrame([(bytearray(c), p) for c, p in cases], "content binary, path string")
    got = sources.with_facts(binary.withColumns({"repository_id": F.lit("r"), "commit_hash": F.lit("c"), "lang": F.lit("en")})).collect()
    assert {r["path"]: r["is_binary"] for r in got} == {p: p[0] == "x" for _, p in cases}


def test_size_limit_is_strict(spark):
    docs = spark.createDataFrame([(i, "x" * (499 + i), "en", "r") for i in range(3)], "doc_id long, text string, lang string, source string")
    assert [r["content_size"] for r in sources.similarity_candidates(sources.from_documents(docs), 500).collect()] == [501]


@pytest.mark.parametrize("made,asked", [(["git/git"], "git/git"), (["c++"], "c++/"), (["a.b1"], "a.b[1]"), (["in-1", "in-22222"], "in*"), (["d/x", "e/f/x"], "{d,e/f}"), (["[1]"], "\\[1\\]")])
def test_repositories_are_named_by_the_first_level_below_the_root(spark, tmp_path, made, asked):
    """Whatever the root is: with signs that patterns use, a pattern of several roots, roots of several depths."""
    for root in made:
        for repo in ("repoA", "git"):
            at = tmp_path / root / repo / "git" / "sub"
            at.mkdir(parents=True)
            (at / f"{root[:1]}.py").write_text("x = 1\n")
    found = sources.from_folder(spark, f"{tmp_path}/{asked}").collect()
    first = "x/" if asked.startswith("{") else ""
    got = {(r["repository_id"], r["path"]) for r in found}
    repos = {"x"} if first else {"repoA", "git"}
    assert {r for r, _ in got} == repos and len(found) == 2 * len(made)
    assert {p for _, p in got} == {(f"{repo}/" if first else "") + f"git/sub/{root[:1]}.py" for root in made for repo in ("repoA", "git")}


PYTHON = {
    "two.py": ("def A(): pass\ndef B(): pass\n", [("A", 1), ("B", 2)]),
    "nested.py": ("def A():\n    def a(): pass\ndef B(): pass\n", [("A", 1), ("B", 3)]),
    "inner.py": ("class A:\n    def a(self):\n        class B:\n            def b(self):\n                pass\n", [("a", 2)]),
    "broken.py": ("def A(:\n", []),
    "empty.py": ("", []),
    "decorated.py": ("@x\nasync def f():\n    return 1\n", [("f", 2)]),
}


def source_files(spark, rows):
    return spark.createDataFrame([(n, bytearray(t.encode() if isinstance(t, str) else t) if t is not None else None, lang, "r", "c", n) for n, t, lang in rows],
                                 "blob_id string, content binary, lang string, repository_id string, commit_hash string, path string")


def functions(spark, rows):
    files, got = source_files(spark, rows), {}
    nodes = trees.nodes_of(files).cache()
    for r in features.function_items(files, nodes).collect():
        got.setdefault(r["blob_id"], []).append((r["fn_name"], r["fn_line"], r["text"]))
        assert r["doc"] == f"{r['blob_id']}_{r['fn_name']}:{r['fn_line']}"
    return nodes, {k: sorted(v, key=lambda x: x[1]) for k, v in got.items()}


def test_functions_of_python_files(spark):
    """Outermost functions only, whatever classes they lie in; files that do not parse are named and stop nothing."""
    rows = [(n, t, "Python") for n, (t, _) in PYTHON.items()] + [("none", None, "Python"), ("latin", b"# \xe9\ndef g(): pass\n", "Python"), ("text", "def h(): pass", "en"), ("nolang", "def h(): pass", None)]
    nodes, got = functions(spark, rows)
    assert all("def " in t for v in got.values() for _, _, t in v)
    assert {k: [x[:2] for x in v] for k, v in got.items()} == {n: f for n, (_, f) in PYTHON.items() if f} | {"latin": [("g", 2)]}
    assert [r["doc"] for r in nodes.where("error is not null").collect()] == ["broken.py"]
    inside = trees.item_nodes(nodes, functions=True).where("doc = 'inner.py_a:2'").collect()
    assert sum(r["parent_id"] is None for r in inside) == 1 and "ClassDef" in {r["internal_type"] for r in inside}


def test_function_texts_are_their_own(spark):
    """Line ends of other kinds, characters of several bytes and decorators do not move a function's text."""
    texts = {
        "feed": "x = 1\n\x0c\ndef f():\n    return '\u2028é'\n\ndef g(): return 2\n", "crlf": "# é\r\n@d(1)\r\ndef f():\r\n    pass\r\n", "old": "x = 'éé'; f = 1\rdef f(): pass\r",
        "wide": "class A:\n  @staticmethod\n  @x.y(\n   'ü')\n  async def f(): return '日本'; y = 1\n",
    }
    _, got = functions(spark, [(n, t, "Python") for n, t in texts.items()])
    assert [x[2] for x in got["feed"]] == ["def f():\n    return '\u2028é'", "def g(): return 2"]
    assert got["crlf"] == [("f", 3, "@d(1)\r\ndef f():\r\n    pass")] and got["old"] == [("f", 2, "def f(): pass")]
    assert got["wide"] == [("f", 5, "@staticmethod\n  @x.y(\n   'ü')\n  async def f(): return '日本'; y = 1")]


BRACES = {
    "a.go": ("\npackage p\nfunc A() {}\nfunc B() {}\n", "Go", [("A", 3), ("B", 4)]),
    "b.go": ("\npackage p\nfunc A() { a := func() {}}\nfunc B() {}\n", "Go", [("A", 3), ("B", 4)]),
    "c.py": ("\nclass A:\n    def a(self):\n        class B:\n            def b(self):\n                pass\n", "Python", [("a", 3)]),
    "types.go": ('type F func(a int) (b, c string)\ntype S struct { f func(x int) string }\nvar v = func() int { return 1 }\nvar w = map[string]func(){ "a": func() {} }\n'
                 'func (s *S) M(a int, f func(int) interface{}) (r struct{ x int }, err error) { s := "}"; t := `{`; r := \'{\'; /* { */ // {\n}\n'
                 "func Map[T any](xs []T, f func(T) T) []T {\n\treturn nil\n}\nfunc outside(a int) string\nfunc I() interface{} { return nil }\n", "Go", [("M", 5), ("Map", 7), ("outside", 10), ("I", 11)]),
    "C.java": ('@Ann(v = "}") public class Foo<T> {\n int x = compute(1);\n Map<String, List<int[]>> m = new HashMap<>() {{ put("a"); }};\n Foo() { this(1); }\n'
               " public Foo(int a) throws X, Y { if (a > 1) { foo(); } for (;;) { bar(i); } }\n @Override public <R> Map<String, R> get(final int[] k, String... s) { return run(() -> { return 1; }); }\n"
               ' int[] arr() { return new int[] {1}; }\n abstract void later(int a);\n Runnable r = new Runnable() { public void run() { x(); } };\n static { init(); }\n'
               ' enum Color { RED(1), GREEN(2); Color(int c) { } }\n interface I { int value() default 5; default void h() { try { a(); } catch (E e) { b(); } } }\n String t = """\n  class Z { void no() {} """;\n'
               " record P(int a) { int sum() { return a; } }\n}\n", "Java",
               [("Foo", 4), ("Foo", 5), ("get", 6), ("arr", 7), ("later", 8), ("run", 9), ("Color", 11), ("h", 12), ("value", 12), ("sum", 15)]),
    "d.js": ("export default function main(a, {b} = {}) { const r = /[/}]{2}/g.test(`a ${ fn({a: `}`}) } {`); return a / b / c; }\nasync function go() { await f(function named() { }); }\n"
             "const arrow = (x) => { return x; };\nclass A extends B { constructor(x) { super(x); } static async run() { } get v() { return 1; } *gen() {} #priv() {} f = () => { a(); }\n late() {} }\n"
             "const o = { m() { return 1; }, k: function () { return 2; }, async n(a) { } };\nfoo(function () { while (x) { y() } });\nif (a) { b(); }\nlet e = function inner() {}\nfunction last() {}\n",
             "JavaScript", [("main", 1), ("go", 2), ("constructor", 4), ("run", 4), ("v", 4), ("gen", 4), ("priv", 4), ("late", 5), ("m", 6), ("n", 6), ("last", 10)]),
    "open.go": ("func A() {", "Go", None), "shut.js": ("function a() {}}", "JavaScript", None), "wrong.java": ("class A { void f( { ) }", "Java", None), "tick.js": ("a = `x", "JavaScript", None),
    "empty.go": ("", "Go", []), "words.java": ("no code at all", "Java", []),
}


def test_functions_of_languages_of_braces(spark):
    nodes, got = functions(spark, [(n, t, lang) for n, (t, lang, _) in BRACES.items()])
    assert {n: sorted(x[:2] for x in got.get(n, [])) for n, (_, _, f) in BRACES.items() if f is not None} == {n: sorted(f) for n, (_, _, f) in BRACES.items() if f is not None}
    assert {r["doc"] for r in nodes.where("error like 'Unbalanced:%'").collect()} == {n for n, (_, _, f) in BRACES.items() if f is None}
    assert {x[2] for x in got["b.go"]} == {"func A() { a := func() {}}", "func B() {}"}
    assert "public Foo(int a) throws X, Y { if" in got["C.java"][1][2]


def test_scans_end_and_number_nodes_in_order():
    rng = random.Random(9)
    parts = ["{", "}", "(", ")", "[", "]", "func ", "function ", "class ", "A", " b", "\n", ";", ",", "=", "=>", "/", "`", "${", '"', "'", "//", "/*", "*/", "new ", "interface ", "get ", "1.5", "\\", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        for lang in scanner.LANGUAGES:
            try:
                found = scanner.nodes(text, lang)
            except scanner.Unbalanced:
                continue
            assert [n.node_id for n in found] == list(range(len(found))) and found[0].parent_id is None and found[0].end_at == len(text)
            assert all(n.parent_id is not None and n.parent_id < n.node_id and 0 <= n.start_at <= n.end_at <= len(text) for n in found[1:])


def test_a_file_that_hangs_crashes_or_is_huge_is_counted_and_stops_nothing(spark):
    """One row with the error each; counts come with the same pass, and the skip report names the reasons."""

    def bad(text):
        if text == "hang":
            while True:
                pass
        if text == "crash":
            os._exit(7)
        if text == "raise":
            raise KeyError("odd")
        return trees.python_tree(text)

    texts = ["hang", "x = 1", "crash", "raise", "x = 0x" + "f" * 5000, "def f(:", "y = 2", "(" * 500 + ")" * 500]
    files = sources.with_facts(source_files(spark, [(f"f{i}", t, "Python") for i, t in enumerate(texts)]).withColumn("path", F.concat("path", F.lit(".py"))))
    nodes, seen = trees.observed(trees.nodes_of(files, 1.0, {"Python": bad}))
    nodes = lineage.cut(nodes)
    assert seen.get == {"parsed": 3, "failed": 5, "late": 1, "crashed": 1}
    errors = {r["error"].split(":")[0] for r in nodes.where("error is not null").collect()}
    assert errors == {"TimeoutError", "Crashed", "KeyError", "SyntaxError"}
    got = {r["reason"]: r["files"] for r in sources.skip_report(files, 0, nodes).collect()}
    assert got == {"processed": 3, "no tree: TimeoutError": 1, "no tree: Crashed": 1, "no tree: KeyError": 1, "no tree: SyntaxError": 2}
    assert engine.items_of(files, replace(FILE, min_size=0), nodes).count() == 3  # files without a tree are no items


def test_items_of_files_with_and_without_parsers(spark):
    """Functions of source code, lines of prose; other programming languages have no items in function mode."""
    rows = [("g.go", "func A() {\n}\n", "Go"), ("x.rs", "fn main() {\n}\n", "Rust"), ("p.txt", "some words\n\nmore", "en"), ("bad.go", "func A() {", "Go")]
    files = sources.with_facts(source_files(spark, rows))
    of = {m.name: engine.items_of(files, replace(m, min_size=0), engine.nodes_of(files, replace(m, min_size=0))).collect() for m in (FILE, FUNC)}
    assert sorted((r["path"], r["fn_name"], r["fn_line"]) for r in of["func"]) == [("g.go", "A", 1), ("p.txt", "more", 3), ("p.txt", "some", 1)]
    assert sorted(r["path"] for r in of["file"]) == ["g.go", "p.txt", "x.rs"]


def test_intervals_and_outermost_nodes_against_a_walk(spark):
    rng = random.Random(2)
    rows, want = [], []
    for doc in range(12):
        n = rng.choice([1, 5, 60])
        parent = [None]
        path = [0]
        for i in range(1, n):
            path = path[: rng.randrange(1, len(path) + 1)]
            parent.append(path[-1])
            path.append(i)
        kind = [rng.random() < 0.3 for _ in range(n)]
        last = list(range(n))
        for i in range(n - 1, 0, -1):
            last[parent[i]] = max(last[parent[i]], last[i])
        above = lambda i: parent[i] is not None and (kind[parent[i]] or above(parent[i]))  # noqa: B023, E731
        rows += [(str(doc), i, parent[i], f"t{i}", kind[i]) for i in range(n)]
        for i in range(n):
            if kind[i] and not above(i):
                names = [i] + [j for j in range(n) if parent[j] == i and not kind[j]]
                want.append((str(doc), i, last[i], "+".join(f"t{j}" for j in names if j % 3)))
    rng.shuffle(rows)
    nodes = spark.createDataFrame(rows, "doc string, node_id long, parent_id long, token string, kind boolean")
    got = trees.outermost(nodes, F.col("kind"), F.col("node_id") % 3 != 0).select("doc", "node_id", "last_id", "name").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert trees.outermost(nodes.limit(0), F.col("kind"), F.col("kind")).count() == 0


def test_items_with_trees_have_graphlets_and_node_sequences(spark):
    items = spark.createDataFrame([("d", "def f(): return 1"), ("e", "one two three four")], "doc string, text string")
    nodes = spark.createDataFrame([("d", 0, None, "FunctionDef"), ("d", 1, 0, "arguments"), ("d", 2, 0, "Return"), ("d", 3, 2, "Constant")], "doc string, node_id long, parent_id long, internal_type string")
    got = {(r["doc"], r["feature"]): r["weight"] for r in features.extract(items, FUNC, nodes).collect()}
    assert got["d", "g.None_FunctionDef_Return_arguments"] == FUNC.graphlet and got["d", "s.FunctionDef>arguments>Return"] == FUNC.sequences
    assert got["e", "s.one>two>three"] == FUNC.sequences and not any(d == "d" and f.startswith("s.def") for d, f in got)
    assert {f for d, f in got if d == "e"} == {"i.one", "i.two", "i.three", "i.four", "s.one>two>three", "s.two>three>four"}


def test_a_table_that_cannot_be_read_is_no_empty_table(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("meta").isEmpty()
    with store.job() as job:
        job.save_meta(spark.createDataFrame([("a", "r", "c", "p")], "sha1 string, repo string, commit string, path string"))
    assert store.read("meta").count() == 1
    for part in (tmp_path / "hashes").glob("meta/*/*.parquet"):
        part.write_bytes(b"no parquet")
        part.with_name(f".{part.name}.crc").unlink()
    with pytest.raises(Exception):  # noqa: B017
        store.read("meta").count()


def state(store):
    return {t: sorted(map(str, store.read(t).collect())) for t in SCHEMAS}


@pytest.mark.parametrize("replace", [False, True])
@pytest.mark.parametrize("dies_in", ["save_docfreq", "save_bands", "write"])
def test_a_job_that_dies_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch, dies_in, replace):
    """Killed between two tables or while it switches: nothing of it counts, what it was to replace is there, a rerun is whole."""
    docs = documents(spark)
    store, whole = Store(spark, str(tmp_path)), Store(spark, str(tmp_path), "other")
    files = sources.from_documents(docs)
    if replace:
        engine.hash_files(sources.from_documents(docs.where("doc_id < 5")), store, FUNC)
        engine.hash_files(sources.from_documents(docs.where("doc_id < 5")), whole, FUNC)
    before = state(store)

    class Killed(Exception):
        pass

    def die(self, *args):
        if dies_in == "write":  # a manifest that is half written
            at, fs = self._at(f"_manifests/{args[0].number:09d}.json")
            out = fs.create(at, False)
            out.write(bytearray(b'{"folders": [{"tab'))
            out.close()
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(Store if dies_in == "write" else Job, dies_in, die)
        with pytest.raises(Killed):
            engine.hash_files(files, store, FUNC, replace)
    assert state(store) == before and store.is_empty("func") != replace
    engine.hash_files(files, store, FUNC, replace)
    engine.hash_files(files, whole, FUNC, replace)
    assert state(store) == state(whole)
    store.vacuum()
    assert state(store) == state(whole) and len(list((tmp_path / "hashes" / "_manifests").glob("*.json"))) == 1


def test_of_two_jobs_at_a_time_one_begins_again(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", "r", "c", "p")], "sha1 string, repo string, commit string, path string")
    with pytest.raises(ConflictError), store.job() as slow:
        slow.save_meta(rows)
        with store.job("once") as fast:
            fast.save_meta(rows)
    assert store.read("meta").count() == 1
    with store.job("once") as again:
        assert again.repeated
        again.name = None


def test_unique_repositories_prefer_remote(spark):
    heads = spark.createDataFrame([("file:///x", "h"), ("github.com/b", "h"), ("github.com/a", "h"), ("file:///y", "g")], "repository_id string, hash string")
    assert {r["hash"]: r["repository_id"] for r in sources.unique_repositories(heads).collect()} == {"h": "github.com/a", "g": "file:///y"}


def test_modes():
    assert mode("func") is FUNC
    with pytest.raises(ValueError):
        mode("repo")


def test_page_nodes(spark):
    html = "<html><body><p>one<br>two</p></body></html>"
    got = pages.nodes(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("doc", "node_id").collect()
    first = [(r["internal_type"], r["parent_id"]) for r in got if r["doc"] == "1"]
    assert first == [("document", None), ("html", 0), ("body", 1), ("p", 2), ("text", 3), ("br", 3), ("text", 3)]
    assert [r["internal_type"] for r in got if r["doc"] == "2"] == ["document"]


@pytest.mark.parametrize("of", [FILE, FUNC])
def test_hash_query_report(spark, tmp_path, of):
    store = Store(spark, str(tmp_path))
    assert store.is_empty(of.name)
    files = sources.from_documents(documents(spark))
    dup, similar = engine.query_files(files, store, of)
    assert dup.isEmpty() and similar.isEmpty()
    engine.hash_files(files, store, of)
    assert not store.is_empty(of.name)
    with pytest.raises(NotEmptyError):
        engine.hash_files(files, store, of)
    engine.hash_files(files, store, of, replace=True)
    assert store.read("meta").count() == 7
    asked = sources.from_documents(documents(spark).where("doc_id = 1"))
    dup, similar = engine.query_files(asked, store, of)
    assert {r["path"] for r in dup.collect()} == {"docs/1.txt", "docs/2.txt"}
    paths = {r["path"] for r in similar.collect()}
    assert "docs/3.txt" in paths or of is FUNC
    assert ("docs/1.txt" in paths) == (of is FUNC)  # file mode leaves equal contents out
    components, groups = engine.report_groups(store, of)
    assert all(r["community"] <= r["element"] for r in groups.collect())
    places = engine.report_places(groups, store, of)
    assert {"repo: r1 commit: " in r["item"] or "repo: r" in r["item"] for r in places.collect()} <= {True}
    store.save_groups(components, groups, of.name)
    assert store.read(f"communities_{of.name}").count() == groups.count()
    store.clean(of.name)
    assert store.is_empty(of.name) and store.read("meta").count() == 7
    store.drop()
    assert store.read("meta").isEmpty()


def test_report_forms(spark):
    meta = sources.meta(sources.readable(sources.from_documents(documents(spark))))
    dup = report.duplicates(meta)
    assert dup.count() == 2
    assert report.duplicate_text(dup).count() == 3
    assert '"count":2' in report.duplicate_json(dup).first()["json"]


def test_stream_adds_what_is_new(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    engine.hash_files(sources.from_documents(documents(spark)), store, FILE)
    before = store.bands("file").count()
    late = documents(spark).where("doc_id = 3").selectExpr("doc_id + 100 as doc_id", "concat(text, ' late') as text", "lang", "source").unionByName(documents(spark).where("doc_id = 1"))
    late.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(late.schema).parquet(str(tmp_path / "in"))
    ingest(stream, store, FILE, str(tmp_path / "ck")).awaitTermination()
    assert store.bands("file").count() == before + FILE.tables


FUNCTION = "def {name}(values, start):\n" + "".join(f"    step_{k} = [value * {k} for value in values if value > start]\n" for k in range(12)) + "    return step_1\n"


def test_cli(spark, tmp_path, capsys, monkeypatch):
    other = "class Other:\n" + "".join(f"    def part{k}(self):\n        yield {{'{k}': self.part{k - 1}(), 'x': lambda: {k}}}\n" for k in range(1, 30))
    texts = [("a", "x.py", FUNCTION.format(name="first")), ("b", "y.py", FUNCTION.format(name="first")), ("b", "z.py", FUNCTION.format(name="first") + "\n\ndef late():\n    pass\n"), ("b", "o.py", other)]
    texts += [("c", f"f{i}.py", "".join(f"def g{i}_{k}():\n    while x{i}{k}:\n        assert y{i}{k} or z{k}{i}\n" for k in range(20))) for i in range(8)]
    for repo, name, text in texts:
        (tmp_path / "in" / repo).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / repo / name).write_text(text)
    (tmp_path / "in" / "a" / "latin.py").write_bytes(b"# caf\xe9\n" + b"number = 1\n" * 80)
    (tmp_path / "in" / "a" / "broken.py").write_text("def broken(:\n" + "number = 2\n" * 80)
    for of in ("file", "func"):
        store = ["--store", str(tmp_path / "store"), "--mode", of]
        model = str(tmp_path / f"{of}.json")
        assert main(["hash", str(tmp_path / "in"), "--docfreq-file", model, *store], spark) == 0
        assert "a\n  b\n  c\n" in capsys.readouterr().out
        assert main(["hash", str(tmp_path / "in"), *store], spark) == 2
        assert main(["query", str(tmp_path / "in" / "a"), "--docfreq-file", model, *store], spark) == 0
        out = capsys.readouterr().out
        assert "duplicate repo: a" in out and ("path: z.py" in out if of == "file" else " function: first line: 1" in out)
        assert main(["report", *store, "-o", "--group-by"], spark) == 0
        out = capsys.readouterr().out
        assert "(2 duplicates)" in out and " similar)" in out and "path: z.py" in out
        assert main(["report", "--output-format", "json", *store], spark) == 0
        found = json.loads(capsys.readouterr().out)
        assert {d["count"] for d in found["duplicates"]} == {2} and any("z.py" in s["item"] for s in found["similarities"])
    # One function asks: its own line and name, and no other.
    one = ["--store", str(tmp_path / "store"), "--mode", "func"]
    assert main(["query", str(tmp_path / "in" / "b" / "z.py") + ":first:1", *one], spark) == 0
    lines = [x for x in capsys.readouterr().out.splitlines() if x.startswith("similar")]
    assert lines and all("_first:1 " in x for x in lines)
    assert main(["query", str(tmp_path / "in" / "b" / "z.py") + ":first:2", *one], spark) == 0
    assert not [x for x in capsys.readouterr().out.splitlines() if x.startswith("similar")]
    assert main(["query", str(tmp_path / "in" / "b" / "z.py") + ":first:1", "--store", str(tmp_path / "store")], spark) == 2


def test_nodes_of_pages_are_handed_on_in_parts(spark):
    from twinsift.sources import pages

    html = "<p>a</p>" * 100
    nodes = pages.nodes(spark.createDataFrame([(i, html) for i in range(250)], "page_id long, html string").coalesce(1))
    sizes = nodes.select("doc").mapInArrow(lambda batches: batches, "doc string").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 250 * 201
    assert len(pages._batch_of([["d", 0, None, 0, 0, "document", "", ["Element"], 0]])) == 1


def test_nodes_of_many_files_come_in_parts_and_roots_alone(spark, monkeypatch):
    monkeypatch.setattr(trees, "ROWS", 7)
    files = source_files(spark, [(f"f{i}", f"x = {i}\n" * i if i % 5 else "(", "Python") for i in range(30)])
    nodes, roots = trees.nodes_of(files).collect(), trees.nodes_of(files, roles=()).collect()
    assert {r["doc"]: r["error"] for r in nodes if r["error"]}.keys() == {f"f{i}" for i in range(0, 30, 5)}
    assert {r["doc"]: max(x["node_id"] for x in nodes if x["doc"] == r["doc"]) for r in nodes if r["node_id"] == 0} == {f"f{i}": 3 * i for i in range(30) if i % 5}
    assert sorted(map(repr, roots)) == sorted(repr(r) for r in nodes if r["error"] or r["node_id"] == 0)
    of = lambda rows: sorted(map(repr, trees.functions_of(rows).collect()))
    more = source_files(spark, [("p", "def f():\n    def g(): pass\n" * 3, "Python"), ("j", "class C { int a() { return b(c); } D e() { return new D() { int f() { return 1; } }; } }", "Java"), ("g", "func a() { b(func() {}) }\n", "Go")])
    assert of(trees.nodes_of(more, roles=("Function",))) == of(trees.nodes_of(more)) and trees.functions_of(trees.nodes_of(more)).count() == 6
