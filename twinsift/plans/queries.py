"""Queries over the driver's tables, each with equal SQL for an independent engine.

Documents stand for files (a source is a repository), their lines for functions, orders with their parts for
weighted sets that need no text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.config import FILE, FUNC, Mode
from twinsift.functions import formatting
from twinsift.functions.hashing import uint32_le
from twinsift.lineage import cut, written
from twinsift.operators import communities as groups
from twinsift.operators import counting, docfreq, features, lsh, report, wmh
from twinsift.operators.bags import bags_in_rows, frequent_features
from twinsift.operators.components import connected_components as components_of
from twinsift.plans import engine
from twinsift.sources import files as sources
from twinsift.sources import pages as page_source
from twinsift.sources import trees

LEAST_DOCS = 5  # fixed value: the threshold that extraction is asked for
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SMALL_SQL: dict[str, str] = {}  # equal, but too slow on whole tables: the tests hold these queries against it on a few documents


def query(sql: str | None = None, small: bool = False):
    def add(f):
        QUERIES[f.__name__.rstrip("_")] = f
        if sql is not None:
            (SMALL_SQL if small else ORACLE)[f.__name__.rstrip("_")] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return sources.from_documents(_table(spark, d, "documents"))


def _readable(spark: SparkSession, d: str) -> DataFrame:
    return sources.readable(_files(spark, d))


def _meta(spark: SparkSession, d: str) -> DataFrame:
    return sources.meta(_readable(spark, d))


def _items(spark: SparkSession, d: str, mode: Mode) -> DataFrame:
    return engine.items_of(_files(spark, d), mode)


def _order_features(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents, parts as features, summed quantities as weights."""
    rows = _table(spark, d, "lineitem")
    return rows.select(F.col("l_partkey").cast("string").alias("feature"), F.col("l_orderkey").cast("string").alias("doc"), F.col("l_quantity").cast("long").alias("weight"))


def _order_bags(spark: SparkSession, d: str) -> DataFrame:
    found = _order_features(spark, d)
    return docfreq.bags(found, docfreq.doc_freq(found), docfreq.count_docs(found))


def _bag_rows(spark: SparkSession, d: str, mode: Mode, named: bool = False) -> DataFrame:
    return bags_in_rows(_items(spark, d, mode), mode, named)


def _bags(spark: SparkSession, d: str, mode: Mode) -> DataFrame:
    rows = _bag_rows(spark, d, mode, named=True).select("doc", F.explode(F.arrays_zip("feature", "v")).alias("f"))
    return rows.select("doc", "f.feature", F.col("f.v").alias("value"))


def _bands(spark: SparkSession, d: str, mode: Mode) -> DataFrame:
    return engine.bands_of_rows(_bag_rows(spark, d, mode), mode)


def _digests(spark: SparkSession, d: str, mode: Mode) -> DataFrame:
    return wmh.digests_in_rows(_bag_rows(spark, d, mode), mode.samples, mode.tables, mode.band)


def _order_bands(spark: SparkSession, d: str) -> DataFrame:
    return engine.bands_of(_order_bags(spark, d), FILE)


def _members(spark: SparkSession, d: str) -> DataFrame:
    return engine.members_of(_order_bags(spark, d), FILE)


# --- SQL of the shared steps, for the independent engine -----------------------------------------------------------

FILES_SQL = """files AS (
    SELECT source AS repository_id, sha1(source) AS commit_hash, 'docs/' || doc_id || '.txt' AS path, doc_id, text, lang,
        sha1('blob ' || strlen(text) || chr(0) || text) AS blob_id, strlen(text)::BIGINT AS content_size
    FROM documents WHERE text IS NOT NULL AND strlen(text) > 0),
meta AS (SELECT DISTINCT blob_id AS sha1, repository_id AS repo, commit_hash AS "commit", path FROM files)"""


def _items_sql(mode: Mode) -> str:
    size = f"AND content_size > {mode.min_size}" if mode.min_size is not None else ""
    chosen = f"""chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY repository_id, path, commit_hash) AS rn
        FROM files WHERE lang IS NOT NULL {size}) WHERE rn = 1)"""
    if mode.name == "file":
        return f"{FILES_SQL}, {chosen}, items AS (SELECT repository_id, commit_hash, path, blob_id, NULL::VARCHAR AS fn_name, NULL::INTEGER AS fn_line, text, blob_id AS doc FROM chosen)"
    return f"""{FILES_SQL}, {chosen}, lines AS (SELECT repository_id, commit_hash, path, blob_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS fn_line FROM chosen),
    items AS (SELECT repository_id, commit_hash, path, blob_id, regexp_extract(lower(line), '[a-z]+') AS fn_name, fn_line, line AS text,
        blob_id || '_' || regexp_extract(lower(line), '[a-z]+') || ':' || fn_line AS doc FROM lines WHERE regexp_matches(line, '[a-z]'))"""


def _names_sql(kind: str, weight: int) -> str:
    names = {
        "i": "SELECT doc, 'i.' || lower(unnest(regexp_extract_all(text, '[A-Z]?[a-z]+|[A-Z]+'))) AS feature FROM items",
        "l": """SELECT doc, 'l.' || substr(md5(unnest(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?|"[^"\\n]*"'))), 1, 16) AS feature FROM items""",
        "s": """SELECT doc, 's.' || w[i] || '>' || w[i + 1] || '>' || w[i + 2] AS feature FROM (SELECT doc, w, unnest(generate_series(1, len(w) - 2)) AS i
            FROM (SELECT doc, regexp_extract_all(lower(text), '[a-z]+') AS w FROM items) WHERE len(w) >= 3)""",
    }[kind]
    return f"SELECT feature, doc, count(*) * {weight} AS weight FROM ({names}) GROUP BY feature, doc"


def _features_sql(mode: Mode) -> str:
    kinds = [("i", mode.identifiers), ("l", mode.literals), ("s", mode.sequences)]
    union = " UNION ALL ".join(_names_sql(k, w) for k, w in kinds if w is not None)
    return f"{_items_sql(mode)}, features AS ({union})"


ORDER_FEATURES_SQL = """features AS (SELECT l_partkey::VARCHAR AS feature, l_orderkey::VARCHAR AS doc, l_quantity::BIGINT AS weight FROM lineitem),
items AS (SELECT DISTINCT doc FROM features)"""

BAGS_SQL = """docs AS (SELECT count(DISTINCT doc) AS docs FROM items),
freq AS (SELECT feature, count(DISTINCT doc) AS df FROM features GROUP BY feature),
bags AS (SELECT * FROM (SELECT doc, f.feature, ln(1 + sum(weight)::DOUBLE) * ln((any_value(docs) // any_value(df))::DOUBLE) AS value
    FROM features f JOIN freq USING (feature), docs GROUP BY doc, f.feature) WHERE value > 0)"""


def _signature_sql(samples: int) -> str:
    p = wmh.P
    u = lambda i: f"((a[{i + 1}] * x + b[{i + 1}]) % {p} + 0.5) / {p}"
    constant = lambda kind, m, plus: "[" + ", ".join(f"{plus} + ('0x' || substr(md5('{kind}:' || s || ':{i}'), 1, 8))::BIGINT % {m}" for i in range(wmh.STREAMS)) + "]"
    return f"""params AS (SELECT s::INTEGER AS s, {constant('a', p - 1, 1)} AS a, {constant('b', p, 0)} AS b FROM range({samples}) t(s)),
hashed AS (SELECT DISTINCT feature, ('0x' || substr(md5(feature), 1, 8))::BIGINT % {p} AS x FROM bags),
draws AS (SELECT s, feature, x, -ln({u(0)} * {u(1)}) AS r, ln(-ln({u(2)} * {u(3)})) AS ln_c, {u(4)} AS beta FROM hashed, params),
levels AS (SELECT doc, s, x, r, ln_c, beta, floor(ln(value) / r + beta) AS t FROM bags JOIN draws USING (feature)),
sig AS (SELECT doc, s, m.k AS k, m.t::BIGINT AS t FROM (SELECT doc, s,
    arg_min(struct_pack(k := x, t := t), struct_pack(a := ln_c - (t - beta) * r - r, x := x)) AS m FROM levels GROUP BY doc, s))"""


_LE = lambda v: "||".join(f"substr(printf('%08x', (({v}) % 4294967296 + 4294967296) % 4294967296), {i}, 2)" for i in (7, 5, 3, 1))


def _bands_sql(mode: Mode) -> str:
    return f"""{_signature_sql(mode.samples)},
bands AS (SELECT doc, (s // {mode.band})::INTEGER AS hashtable, string_agg({_LE('k')}||{_LE('t')}, '' ORDER BY s) AS value FROM sig GROUP BY doc, s // {mode.band})"""


def _all_sql(mode: Mode) -> str:
    return f"{_features_sql(mode)}, {BAGS_SQL}, {_bands_sql(mode)}"


ORDERS_SQL = f"{ORDER_FEATURES_SQL}, {BAGS_SQL}, {_bands_sql(FILE)}"
MEMBERS_SQL = """shared AS (SELECT hashtable, value, count(*) AS weight, min(doc) AS u FROM bands GROUP BY hashtable, value HAVING count(*) > 1),
members AS (SELECT hashtable, value, doc, weight, u FROM bands JOIN shared USING (hashtable, value))"""
COMPONENTS_SQL = """edges AS (SELECT DISTINCT u, doc AS v FROM members WHERE u <> doc),
both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach AS (SELECT u AS node, u AS seen FROM both_ways UNION SELECT node, v FROM reach JOIN both_ways ON seen = u),
components AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"""

URL_SQL = """CASE WHEN starts_with(repo, 'github.com') OR starts_with(repo, 'gitlab.com') THEN 'https://' || regexp_replace(repo, '\\.git$', '') || '/blob/' || "commit" || '/' || path
    WHEN starts_with(repo, 'bitbucket.org') THEN 'https://' || regexp_replace(repo, '\\.git$', '') || '/src/' || "commit" || '/' || path
    ELSE 'repo: ' || regexp_replace(repo, '\\.git$', '') || ' commit: ' || "commit" || ' path: ' || path END"""
DUPLICATES_SQL = "dups AS (SELECT sha1, count(*) AS n FROM meta GROUP BY sha1 HAVING count(*) > 1)"


# --- Files --------------------------------------------------------------------------------------------------------


@query(f"WITH {FILES_SQL} SELECT repository_id, commit_hash, path, blob_id, content_size, lang FROM files")
def files(spark, d):
    return _readable(spark, d).drop("content", "is_binary")


@query("SELECT DISTINCT source AS repository_id FROM documents WHERE source IS NOT NULL")
def list_repositories(spark, d):
    return sources.list_repositories(_files(spark, d)).where("repository_id is not null")


@query("SELECT DISTINCT source AS repository_id FROM documents WHERE source IS NOT NULL ORDER BY 1 LIMIT 3")
def limit_repos(spark, d):
    return sources.list_repositories(_files(spark, d).where("repository_id is not null"), 3)


@query(f"WITH {FILES_SQL} SELECT repository_id, path, blob_id FROM files WHERE repository_id IN ('src1', 'src7')")
def repo_subset(spark, d):
    wanted = spark.createDataFrame([("src1",), ("src7",)], "repository_id string")
    return sources.only_repositories(_readable(spark, d), wanted).select("repository_id", "path", "blob_id")


@query("""WITH heads AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'file://' || c_custkey ELSE 'github.com/c/' || c_custkey END AS repository_id, c_nationkey::VARCHAR AS hash FROM customer)
    SELECT hash, arg_min(repository_id, struct_pack(l := starts_with(repository_id, 'file://') OR repository_id = '', r := repository_id)) AS repository_id FROM heads GROUP BY hash""")
def unique_repos(spark, d):
    key = F.col("c_custkey")
    name = F.when(key % 3 == 0, F.concat(F.lit("file://"), key.cast("string"))).otherwise(F.concat(F.lit("github.com/c/"), key.cast("string")))
    heads = _table(spark, d, "customer").select(name.alias("repository_id"), F.col("c_nationkey").cast("string").alias("hash"))
    return sources.unique_repositories(heads)


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '://[^/]*(.*)', 1) AS path FROM (SELECT page_id, replace(url, '/en/', '/vendor/') AS url FROM pages))
    SELECT page_id, path FROM p WHERE NOT regexp_matches(path, '(^|/)(vendor|node_modules|third_party|bower_components|dist)/|(^|/)\\.git/|\\.min\\.js$')""")
def vendor_filter(spark, d):
    path = F.regexp_extract(F.regexp_replace("url", "/en/", "/vendor/"), "://[^/]*(.*)", 1)
    return _table(spark, d, "pages").select("page_id", path.alias("path")).where(~sources.vendored(F.col("path")))


@query(f"WITH {FILES_SQL} SELECT blob_id, min(struct_pack(r := repository_id, p := path)).r AS repository_id, min(struct_pack(r := repository_id, p := path)).p AS path FROM files GROUP BY blob_id")
def distinct_blobs(spark, d):
    return sources.distinct_blobs(_readable(spark, d)).select("blob_id", "repository_id", "path")


@query(f"WITH {FILES_SQL} SELECT lang, count(*) AS files, sum(content_size)::BIGINT AS bytes FROM files WHERE lang IS NOT NULL GROUP BY lang")
def by_language(spark, d):
    return _readable(spark, d).where("lang is not null").groupBy("lang").agg(F.count("*").alias("files"), F.sum("content_size").alias("bytes"))


@query(f"WITH {_items_sql(FILE)} SELECT repository_id, path, blob_id FROM items")
def similarity_candidates(spark, d):
    return _items(spark, d, FILE).select("repository_id", "path", "blob_id")


@query(f"WITH {_items_sql(FILE)} SELECT repository_id || '//' || path || '@' || blob_id AS document FROM items")
def document_ids(spark, d):
    return sources.with_document_id(sources.similarity_candidates(_readable(spark, d), FILE.min_size)).select("document")


@query(f"WITH {FILES_SQL} SELECT * FROM meta")
def meta(spark, d):
    return _meta(spark, d)


@query("SELECT doc_id, sha1('blob ' || strlen(text) || chr(0) || text) AS sha1 FROM documents")
def git_blob_sha1(spark, d):
    from twinsift.functions.hashing import git_blob_sha1 as blob

    return _table(spark, d, "documents").select("doc_id", blob(F.encode("text", "UTF-8")).alias("sha1"))


@query(f"WITH {FILES_SQL} SELECT count(*) AS files FROM files")
def file_count(spark, d):
    return _readable(spark, d).agg(F.count("*").alias("files"))


@query(f"WITH {FILES_SQL}, n AS (SELECT count(*) AS files FROM files) SELECT files, files AS low, files AS high, true AS exact FROM n")
def file_count_in_time(spark, d):
    """What a minute's count can tell: exact, as in the SQL, if all tasks end in it."""
    found = counting.approximate_count(_readable(spark, d), 60)
    return spark.createDataFrame([(found.n, found.low, found.high, found.exact)], "files long, low long, high long, exact boolean")


@query(f"""WITH f AS (SELECT coalesce(text, '') AS text, lang FROM documents) SELECT CASE WHEN text = '' THEN 'empty' WHEN lang IS NULL THEN 'no language'
    WHEN strlen(text) <= {FILE.min_size} THEN 'small' ELSE 'processed' END AS reason, count(*) AS files FROM f GROUP BY 1""")
def skip_report(spark, d):
    return sources.skip_report(sources.from_documents(_table(spark, d, "documents").fillna("", ["text"])), FILE.min_size)


# --- Features -----------------------------------------------------------------------------------------------------


@query(f"WITH {_items_sql(FILE)} {_names_sql('i', FILE.identifiers)}")
def feat_identifiers(spark, d):
    return features.identifiers(_items(spark, d, FILE), FILE.identifiers)


@query()
def feat_identifiers_stemmed(spark, d):
    return features.identifiers(_items(spark, d, FILE), FILE.identifiers, stem=True)


@query(f"WITH {_features_sql(FILE)}, common AS (SELECT feature FROM features GROUP BY feature HAVING count(DISTINCT doc) >= {LEAST_DOCS}) SELECT * FROM features WHERE feature IN (SELECT feature FROM common)")
def features_frequent(spark, d):
    return frequent_features(_items(spark, d, FILE), replace(FILE, least_docs=LEAST_DOCS))


@query(f"WITH {_items_sql(FILE)} {_names_sql('l', FILE.literals)}")
def feat_literals(spark, d):
    return features.literals(_items(spark, d, FILE), FILE.literals)


@query(f"WITH {_items_sql(FUNC)} {_names_sql('s', FUNC.sequences)}")
def feat_seq(spark, d):
    return features.sequences(_items(spark, d, FUNC), FUNC.sequences)


@query(f"WITH {_features_sql(FILE)} SELECT * FROM features")
def features_file(spark, d):
    return features.extract(_items(spark, d, FILE), FILE)


@query(f"WITH {_features_sql(FUNC)} SELECT * FROM features")
def features_func(spark, d):
    return features.extract(_items(spark, d, FUNC), FUNC)


#: Trees of pages: tokens of the text, then a walk over them with the path of open elements.
PAGES_SQL = r"""tok AS (SELECT page_id::VARCHAR AS doc, list_transform(regexp_extract_all(coalesce(html, ''), '(?s)<!--.*?-->|<!.*?>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>|[^<]+'),
        lambda t: CASE WHEN regexp_matches(t, '^<(script|style)') THEN [regexp_extract(t, '^<[^>]*>'), '=' || regexp_extract(t, '(?s)^<[^>]*>(.*)</[a-z]+>$', 1), '</' || regexp_extract(t, '^<([a-z]+)', 1) || '>']
            WHEN starts_with(t, '<') THEN [t] ELSE ['=' || t] END) AS ts FROM pages),
    piece AS (SELECT doc, unnest(flatten(ts)) AS t, generate_subscripts(flatten(ts), 1) AS k FROM tok),
    step AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY k) AS k, CASE WHEN starts_with(t, '=') THEN 'text' ELSE lower(regexp_extract(t, '^</?([a-zA-Z0-9]+)', 1)) END AS tag,
        starts_with(t, '</') AS closes, CASE WHEN starts_with(t, '=') THEN replace(replace(replace(replace(replace(replace(replace(trim(t[2:], E' \n\t\r'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') ELSE '' END AS token
        FROM piece WHERE NOT starts_with(t, '<!') AND trim(t, E'= \n\t\r') <> ''),
    walk AS (SELECT page_id::VARCHAR AS doc, 0::BIGINT AS k, 0::BIGINT AS node_id, NULL::BIGINT AS parent_id, 0 AS depth, 'document' AS internal_type, '' AS token, [0::BIGINT] AS path, ['document'] AS tags, 1::BIGINT AS fresh FROM pages
        UNION ALL SELECT w.doc, s.k, CASE WHEN closes THEN NULL ELSE fresh END, CASE WHEN NOT closes THEN path[-1] END, len(path), tag, s.token,
            CASE WHEN NOT closes AND tag NOT IN ('text', 'area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'track', 'wbr') THEN list_append(path, fresh)
                WHEN closes AND list_contains(tags[2:], tag) THEN path[:len(path) - list_position(list_reverse(tags), tag)] ELSE path END,
            CASE WHEN NOT closes AND tag NOT IN ('text', 'area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'track', 'wbr') THEN list_append(tags, tag)
                WHEN closes AND list_contains(tags[2:], tag) THEN tags[:len(path) - list_position(list_reverse(tags), tag)] ELSE tags END,
            CASE WHEN closes THEN fresh ELSE fresh + 1 END
        FROM walk w JOIN step s ON s.doc = w.doc AND s.k = w.k + 1),
    tree AS (SELECT doc, node_id, parent_id, depth::INTEGER AS depth, internal_type, token, path FROM walk WHERE node_id IS NOT NULL)"""


@query(f"""WITH RECURSIVE {PAGES_SQL} SELECT doc, node_id, coalesce(parent_id, -1) AS parent_id, depth, (row_number() OVER (PARTITION BY doc, parent_id ORDER BY node_id) - 1)::INTEGER AS ord, internal_type, token,
    CASE WHEN internal_type = 'text' THEN 'Literal' ELSE 'Element' END AS role FROM tree""")
def uast_nodes(spark, d):
    return page_source.nodes(_table(spark, d, "pages")).withColumns({"role": F.col("roles")[0], "parent_id": F.coalesce("parent_id", F.lit(-1).cast("long"))}).drop("roles", "last_id")


@query(f"""WITH RECURSIVE {PAGES_SQL}, kids AS (SELECT doc, parent_id AS node_id, string_agg('_' || internal_type, '' ORDER BY internal_type) AS k FROM tree WHERE parent_id IS NOT NULL GROUP BY ALL)
    SELECT feature, doc, count(*) * {FILE.graphlet} AS weight FROM (SELECT t.doc, 'g.' || coalesce(p.internal_type, 'None') || '_' || t.internal_type || coalesce(k, '') AS feature
        FROM tree t LEFT JOIN tree p ON p.doc = t.doc AND p.node_id = t.parent_id LEFT JOIN kids ON kids.doc = t.doc AND kids.node_id = t.node_id) GROUP BY feature, doc""")
def feat_graphlet(spark, d):
    nodes, _ = written(page_source.nodes(_table(spark, d, "pages")).drop("roles", "token", "last_id"))
    return features.graphlets(nodes, FILE.graphlet)


@query(f"""WITH RECURSIVE {PAGES_SQL}, kind AS (SELECT doc, node_id FROM tree WHERE internal_type IN ('p', 'ul', 'div')),
    up AS (SELECT doc, node_id, parent_id FROM tree UNION ALL SELECT up.doc, up.node_id, t.parent_id FROM up JOIN tree t ON t.doc = up.doc AND t.node_id = up.parent_id),
    inner_ones AS (SELECT DISTINCT up.doc, up.node_id FROM up JOIN kind k ON k.doc = up.doc AND k.node_id = up.parent_id),
    last_ones AS (SELECT doc, parent_id AS node_id, max(node_id) AS last_id FROM up WHERE parent_id IS NOT NULL GROUP BY doc, parent_id)
    SELECT k.doc, k.node_id, coalesce(last_id, k.node_id) AS last_id, coalesce((SELECT string_agg(t.token, '+' ORDER BY t.node_id) FROM tree t WHERE t.doc = k.doc AND t.parent_id = k.node_id AND t.internal_type = 'text'), '') AS name
    FROM kind k LEFT JOIN last_ones l ON l.doc = k.doc AND l.node_id = k.node_id WHERE (k.doc, k.node_id) NOT IN (SELECT doc, node_id FROM inner_ones)""")
def outermost_elements(spark, d):
    """Paragraphs, lists and boxes that lie in no other of these, named by the texts right below them."""
    nodes, _ = written(page_source.nodes(_table(spark, d, "pages")).drop("roles"))
    return trees.outermost(nodes, F.col("internal_type").isin("p", "ul", "div"), F.col("internal_type") == "text").select("doc", "node_id", "last_id", "name")


@query(f"WITH {_items_sql(FUNC)} SELECT doc, repository_id, path, fn_name, fn_line FROM items")
def func_items(spark, d):
    return _items(spark, d, FUNC).select("doc", "repository_id", "path", "fn_name", "fn_line")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents as source files in four languages: each line with a word is a function that holds another, with the line
    as a string; documents without a language miss the end of a group."""
    q, plain = F.lit('"'), F.regexp_replace(F.regexp_replace(F.col("line"), r'[\x00-\x1f\u2028\u2029\x85]', " "), r'([\\"])', r"\\$1")
    text = F.concat(q, plain, q)
    kind, name = F.col("kind"), F.concat(F.regexp_extract(F.lower("line"), "[a-z]+", 0), F.lit("_"), F.col("i").cast("string"))
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    function = (
        F.when(kind == 0, say("func ", name, "() { // {\n\tf := func() string { return ", text, " }\n}"))
        .when(kind == 1, say("void ", name, "() { /* } */\n Object f = new Object() { String g() { return ", text, "; } };\n}"))
        .when(kind == 2, say("function ", name, "() {\n  function f() { return /[}\"]/.test(", text, ") }\n}"))
        .otherwise(say("def ", name, "():\n    def f():\n        return ", text))
    )
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(x.alias("line"), (i + 1).alias("i")))
    rows = _table(spark, d, "documents").where("text is not null").select("doc_id", "lang", (F.col("doc_id") % 4).alias("kind"), F.posexplode(F.filter(lines, lambda x: x["line"].rlike("[a-z]"))).alias("n", "x"))
    rows = rows.select("doc_id", "lang", "kind", "n", "x.*").withColumn("function", function)
    begin = F.when(kind == 0, "package p\n").when(kind == 1, "class C {\n").otherwise("")
    end = F.concat(F.when(kind == 1, "\n}\n").otherwise("\n"), F.when(F.col("lang").isNull(), F.when(kind == 3, "x = (\n").otherwise("{")).otherwise(""))
    whole = rows.groupBy("doc_id", "lang", "kind").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "function"))), lambda x: x["function"]), "\n").alias("body"))
    return whole.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("blob_id"), F.lit("r").alias("repository_id"), F.lit("c").alias("commit_hash"),
                        F.col("doc_id").cast("string").alias("path"), F.encode(F.concat(begin, "body", end), "UTF-8").alias("content"),
                        F.element_at(F.array(*map(F.lit, ("Go", "Java", "JavaScript", "Python"))), (kind + 1).cast("int")).alias("lang"))


SOURCES_SQL = """ls AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
    fs AS (SELECT doc_id, lang, doc_id % 4 AS kind, regexp_extract(lower(line), '[a-z]+') || '_' || i AS fn_name, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n,
        '"' || regexp_replace(regexp_replace(line, '[\\x00-\\x1f\\x{2028}\\x{2029}\\x85]', ' ', 'g'), '([\\\\"])', '\\\\\\1', 'g') || '"' AS s FROM ls WHERE regexp_matches(line, '[a-z]'))"""


@query(f"""WITH {SOURCES_SQL} SELECT 'd' || doc_id AS blob_id, fn_name, (CASE kind WHEN 0 THEN 2 + 3 * n WHEN 1 THEN 2 + 3 * n ELSE 1 + 3 * n END)::INTEGER AS fn_line, md5(CASE kind
        WHEN 0 THEN 'func ' || fn_name || '() {{ // {{' || chr(10) || chr(9) || 'f := func() string {{ return ' || s || ' }}' || chr(10) || '}}'
        WHEN 1 THEN 'void ' || fn_name || '() {{ /* }} */' || chr(10) || ' Object f = new Object() {{ String g() {{ return ' || s || '; }} }};' || chr(10) || '}}'
        WHEN 2 THEN 'function ' || fn_name || '() {{' || chr(10) || '  function f() {{ return /[}}"]/.test(' || s || ') }}' || chr(10) || '}}'
        ELSE 'def ' || fn_name || '():' || chr(10) || '    def f():' || chr(10) || '        return ' || s END) AS text_md5
    FROM fs WHERE lang IS NOT NULL""")
def extract_functions(spark, d):
    files = _sources(spark, d)
    found = features.function_items(files, written(trees.nodes_of(files, roles=("Function",)))[0])
    return found.select("blob_id", "fn_name", "fn_line", F.md5("text").alias("text_md5"))


@query(f"""WITH {SOURCES_SQL}, docs AS (SELECT DISTINCT doc_id, lang, kind FROM fs)
    SELECT CASE WHEN lang IS NOT NULL THEN 'processed' WHEN kind = 3 THEN 'no tree: SyntaxError' ELSE 'no tree: Unbalanced' END AS reason, count(*) AS files FROM docs GROUP BY 1""")
def parse_errors(spark, d):
    files = cut(sources.with_facts(_sources(spark, d)))
    return sources.skip_report(files, 0, trees.nodes_of(files, roles=()))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """A Python file for each part: a class with a method that holds another, a function, and, for some, a broken line."""
    key, size = (F.col(c).cast("string") for c in ("p_partkey", "p_size"))
    text = F.concat(F.lit("class Part"), key, F.lit(":\n    def total"), size, F.lit("(self):\n        def inner():\n            return "), size,
                    F.lit("\n        return inner()\n\n\ndef name"), key, F.lit("(x):\n    return x\n"), F.when(F.col("p_partkey") % 10 == 0, F.lit("def broken(:\n")).otherwise(""))
    return _table(spark, d, "part").select(F.concat(F.lit("b"), key).alias("blob_id"), F.encode(text, "UTF-8").alias("content"), F.lit("Python").alias("lang"))


@query(f"""WITH t(feature, n) AS (VALUES ('g.None_Module_ClassDef_FunctionDef', 1), ('g.Module_ClassDef_FunctionDef', 1), ('g.ClassDef_FunctionDef_FunctionDef_Return_arguments', 1),
        ('g.FunctionDef_arguments_arg', 2), ('g.arguments_arg', 2), ('g.FunctionDef_FunctionDef_Return_arguments', 1), ('g.FunctionDef_arguments', 1), ('g.FunctionDef_Return_Constant', 1),
        ('g.Return_Constant', 1), ('g.FunctionDef_Return_Call', 1), ('g.Return_Call_Name', 1), ('g.Call_Name', 1), ('g.Module_FunctionDef_Return_arguments', 1), ('g.FunctionDef_Return_Name', 1), ('g.Return_Name', 1))
    SELECT feature, 'b' || p_partkey AS doc, (n * {FILE.graphlet})::BIGINT AS weight FROM part, t WHERE p_partkey % 10 <> 0""")
def graphlets_of_sources(spark, d):
    nodes, _ = written(trees.item_nodes(trees.nodes_of(_parts(spark, d)), functions=False).drop("roles"))
    return features.graphlets(nodes, FILE.graphlet)


# --- Frequencies and bags -----------------------------------------------------------------------------------------


@query(f"WITH {_features_sql(FILE)}, {BAGS_SQL} SELECT docs FROM docs")
def features_docs(spark, d):
    return docfreq.count_docs(_items(spark, d, FILE))


@query(f"WITH {_features_sql(FILE)}, {BAGS_SQL} SELECT feature, df FROM freq")
def features_freq(spark, d):
    return docfreq.doc_freq(features.extract(_items(spark, d, FILE), FILE), once=True)


@query(f"WITH {_features_sql(FILE)}, {BAGS_SQL} SELECT feature, df FROM freq ORDER BY feature")
def docfreq_ordered(spark, d):
    return features_freq(spark, d).orderBy("feature")


@query(f"WITH {_features_sql(FILE)}, {BAGS_SQL} SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS feature_idx FROM freq")
def vocabulary(spark, d):
    return docfreq.vocabulary(cut(features_freq(spark, d)), per_range=20_000)


@query(f"WITH {ORDER_FEATURES_SQL} SELECT feature, doc, sum(weight)::BIGINT AS tf FROM features GROUP BY feature, doc")
def term_freq(spark, d):
    return docfreq.term_freq(_order_features(spark, d))


@query(f"WITH {ORDER_FEATURES_SQL}, {BAGS_SQL} SELECT doc, feature, round(value, 9) AS value FROM bags")
def tfidf(spark, d):
    return _order_bags(spark, d).withColumn("value", F.round("value", 9))


@query(f"WITH {_features_sql(FILE)}, {BAGS_SQL} SELECT doc, feature, round(value, 9) AS value FROM bags")
def bag_of_features(spark, d):
    return _bags(spark, d, FILE).withColumn("value", F.round("value", 9))


# --- Signatures, bands, tables ------------------------------------------------------------------------------------


@query(f"""WITH t AS (SELECT unnest([0, 1, 12345, 4294967295, 4294967296, 4294967297, -1]) AS n UNION ALL SELECT o_orderkey FROM orders) SELECT n, {_LE('n')} AS le FROM t""")
def uint32_le_(spark, d):
    few = spark.createDataFrame([(n,) for n in (0, 1, 12345, 4294967295, 4294967296, 4294967297, -1)], "n long")
    return few.unionByName(_table(spark, d, "orders").select(F.col("o_orderkey").alias("n"))).select("n", uint32_le(F.col("n")).alias("le"))



BAND_CASES = [(0.8, 128), (FILE.threshold, FILE.samples), (FUNC.threshold, FUNC.samples)]
_AREA_SQL = "list_sum(list_transform(range(256), lambda i: {chance})) * {width} / 256"
_MISS_SQL = "pow(1 - pow({low} + {width} * (i + 0.5::DOUBLE) / 256, band), t)"


@query(f"""WITH cases AS (SELECT round(l_discount * 100)::INT / 10::DOUBLE AS threshold, l_quantity::INT AS samples FROM lineitem
        UNION SELECT * FROM (VALUES {", ".join(f"({t}::DOUBLE, {n})" for t, n in BAND_CASES)})),
    ts AS (SELECT threshold, samples, unnest(range(1, samples + 1))::INT AS t FROM cases WHERE threshold BETWEEN 0 AND 1 AND samples >= 1),
    splits AS (SELECT *, unnest(range(1, samples // t + 1))::INT AS band FROM ts),
    errors AS (SELECT *, round(0.5 * {_AREA_SQL.format(width="threshold", chance="1 - " + _MISS_SQL.format(low="0", width="threshold"))}
        + 0.5 * {_AREA_SQL.format(width="(1 - threshold)", chance=_MISS_SQL.format(low="threshold", width="(1 - threshold)"))}, 12) AS error FROM splits)
    SELECT threshold, samples, best.t AS "tables", best.band AS band FROM (SELECT threshold, samples, arg_min({{'t': t, 'band': band}}, (error, t, band)) AS best FROM errors GROUP BY ALL)""")
def band_params(spark, d):
    """Parameters for the modes, and for each threshold and number of samples that order lines give as discount and quantity."""
    lines = _table(spark, d, "lineitem").select((F.round(F.col("l_discount") * 100).cast("int") / 10.0).alias("threshold"), F.col("l_quantity").cast("int").alias("samples"))
    return lsh.best_bands(lines.unionByName(spark.createDataFrame(BAND_CASES, "threshold double, samples int")))


@query(f"WITH {_features_sql(FILE)}, {BAGS_SQL}, {_signature_sql(FILE.samples)} SELECT doc, s, k, t FROM sig")
def wmh_signature(spark, d):
    return wmh.long_form(wmh.signatures_of_packed(_bag_rows(spark, d, FILE), FILE.samples))


@query(f"WITH {ORDER_FEATURES_SQL}, {BAGS_SQL}, {_signature_sql(16)} SELECT doc, s, k, t FROM sig")
def wmh_signature_sql(spark, d):
    return wmh.signatures_sql(_order_bags(spark, d), 16)


@query(f"WITH {ORDERS_SQL} SELECT doc, hashtable, value FROM bands")
def lsh_bands(spark, d):
    return _order_bands(spark, d)


@query(f"WITH {_all_sql(FILE)} SELECT doc, hashtable, value FROM bands")
def hashtables_file(spark, d):
    return _bands(spark, d, FILE)


@query(f"WITH {_all_sql(FUNC)} SELECT doc, hashtable, value FROM bands", small=True)
def hashtables_func(spark, d):
    return _bands(spark, d, FUNC)


@query(f"WITH {ORDERS_SQL} SELECT DISTINCT hashtable FROM bands ORDER BY 1")
def list_hashtables(spark, d):
    return _order_bands(spark, d).select("hashtable").distinct().orderBy("hashtable")


@query(f"WITH {FILES_SQL} SELECT (count(*) = 0) AS is_empty FROM meta")
def db_is_empty(spark, d):
    return spark.createDataFrame([(_meta(spark, d).limit(1).isEmpty(),)], "is_empty boolean")


# --- Buckets and graphs -------------------------------------------------------------------------------------------


@query(f"WITH {ORDERS_SQL}, {MEMBERS_SQL} SELECT hashtable, value, doc FROM members")
def lsh_buckets(spark, d):
    return _members(spark, d)


@query(f"WITH {ORDERS_SQL}, {MEMBERS_SQL} SELECT doc, string_agg(hashtable || ':' || value, ',' ORDER BY hashtable, value) AS buckets FROM members GROUP BY doc")
def element_buckets(spark, d):
    listed = F.sort_array(F.collect_list(F.struct("hashtable", "value")))  # at most one bucket per table
    return _members(spark, d).groupBy("doc").agg(F.array_join(F.transform(listed, lambda b: F.concat_ws(":", b["hashtable"], b["value"])), ",").alias("buckets"))


@query(f"WITH {ORDERS_SQL}, {MEMBERS_SQL} SELECT hashtable, value, weight FROM shared")
def bucket_weights(spark, d):
    return lsh.bucket_weights(_members(spark, d))


@query(f"WITH {ORDERS_SQL}, {MEMBERS_SQL} SELECT doc, hashtable, value, weight FROM members")
def linear_edges(spark, d):
    return lsh.linear_edges(_members(spark, d))


@query(f"WITH {ORDERS_SQL}, {MEMBERS_SQL} SELECT l.doc AS a, r.doc AS b, count(*) AS bands FROM members l JOIN members r ON l.hashtable = r.hashtable AND l.value = r.value AND l.doc < r.doc GROUP BY 1, 2")
def quadratic_edges(spark, d):
    return lsh.quadratic_edges(_members(spark, d))


@query(f"WITH {_all_sql(FILE)}, {MEMBERS_SQL} SELECT l.doc AS a, r.doc AS b, count(*) AS bands FROM members l JOIN members r ON l.hashtable = r.hashtable AND l.value = r.value AND l.doc < r.doc GROUP BY 1, 2")
def similar_pairs(spark, d):
    members, _ = written(lsh.members_of_digests(_digests(spark, d, FILE)))
    return lsh.quadratic_edges(members, lsh.DIGEST)


@query(f"WITH RECURSIVE {ORDERS_SQL}, {MEMBERS_SQL}, {COMPONENTS_SQL} SELECT node, component FROM components")
def connected_components(spark, d):
    return components_of(lsh.star_edges(_members(spark, d)))


@query(f"WITH RECURSIVE {ORDERS_SQL}, {MEMBERS_SQL}, {COMPONENTS_SQL} SELECT component, string_agg(node, ',' ORDER BY node) AS elements FROM components GROUP BY component")
def cc_arrays(spark, d):
    return connected_components(spark, d).groupBy("component").agg(F.array_join(F.sort_array(F.collect_list("node")), ",").alias("elements"))


@query(f"WITH RECURSIVE {ORDERS_SQL}, {MEMBERS_SQL}, {COMPONENTS_SQL} SELECT component AS community, node AS element FROM components WHERE component IN (SELECT component FROM components GROUP BY component HAVING count(*) = 2)")
def communities_small(spark, d):
    found = cut(connected_components(spark, d))
    pairs = found.groupBy("component").agg(F.count("*").alias("n")).where("n = 2").select("component")
    return found.join(pairs, "component", "left_semi").select(F.col("component").alias("community"), F.col("node").alias("element"))


def _communities(members: DataFrame) -> DataFrame:
    return groups.communities(lsh.linear_edges(members), components_of(lsh.star_edges(members)))


@query()
def communities(spark, d):
    return _communities(_members(spark, d))


@query()
def community_stats(spark, d):
    sizes = communities(spark, d).groupBy("community").agg(F.count("*").alias("n"))
    return sizes.agg(F.avg("n").alias("mean"), F.median("n").alias("median"), F.max("n").alias("most"))


# --- Lookups and reports ------------------------------------------------------------------------------------------


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Every document whose id is divisible by 20 asks."""
    return sources.from_documents(_table(spark, d, "documents").where("doc_id % 20 = 0"))


@query(f"WITH {FILES_SQL} SELECT sha1, repo, \"commit\", path FROM meta WHERE sha1 IN (SELECT blob_id FROM files WHERE doc_id % 20 = 0)")
def find_files_by_hash(spark, d):
    return report.find_by_hash(_asked(spark, d).select(F.col("blob_id").alias("sha1")), _meta(spark, d))


@query(f"WITH {FILES_SQL} SELECT doc_id, m.sha1, repo, \"commit\", m.path FROM files f JOIN meta m ON f.blob_id = m.sha1 WHERE doc_id % 20 = 0 AND f.path <> m.path")
def query_duplicates(spark, d):
    asked = _asked(spark, d).select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("doc_id"), F.col("blob_id").alias("sha1"), F.col("path").alias("own"))
    return asked.join(_meta(spark, d), "sha1").where("own <> path").drop("own")


def _asking(spark: SparkSession, d: str, mode: Mode, line: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, those that ask (in function mode, of one line), and the digests of all."""
    whole, _ = written(_items(spark, d, mode))
    items = whole.drop("text")
    asked = items if line is None else items.where(F.col("fn_line") == line)
    asked = asked.join(_asked(spark, d).select("blob_id").distinct(), "blob_id", "left_semi")
    return items, asked, written(wmh.digests_in_rows(bags_in_rows(whole, mode), mode.samples, mode.tables, mode.band))[0]


def _lookup(spark: SparkSession, d: str, mode: Mode) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, those that ask, and the candidates of those."""
    items, asked, digests = _asking(spark, d, mode)
    return items, asked, lsh.candidates_of_digests(asked, digests)


ASKED_SQL = "asked AS (SELECT doc, blob_id FROM items WHERE blob_id IN (SELECT blob_id FROM files WHERE doc_id % 20 = 0))"
CANDIDATES_SQL = f"{ASKED_SQL}, cands AS (SELECT DISTINCT q.doc AS query_doc, b.doc FROM bands q JOIN asked USING (doc) JOIN bands b ON q.hashtable = b.hashtable AND q.value = b.value)"


@query(f"WITH {_all_sql(FILE)}, {CANDIDATES_SQL} SELECT * FROM cands")
def query_similar_candidates(spark, d):
    return _lookup(spark, d, FILE)[2]


@query(f"""WITH {_all_sql(FILE)}, {CANDIDATES_SQL} SELECT query_doc, repo, "commit", m.path, sha1, fn_name, fn_line FROM cands JOIN items i ON cands.doc = i.doc JOIN meta m ON i.blob_id = m.sha1 WHERE query_doc <> cands.doc""")
def query_similar(spark, d):
    items, asked, found = _lookup(spark, d, FILE)
    return report.similar(found, items, _meta(spark, d), asked, drop_equal=True)


@query(f"""WITH {_all_sql(FUNC)}, {CANDIDATES_SQL} SELECT query_doc, repo, "commit", m.path, sha1, fn_name, fn_line FROM cands JOIN items i ON cands.doc = i.doc JOIN meta m ON i.blob_id = m.sha1
    WHERE query_doc IN (SELECT doc FROM items WHERE fn_line = 1)""", small=True)
def query_func_filtered(spark, d):
    items, asked, digests = _asking(spark, d, FUNC, line=1)
    return report.similar_of_classes(*lsh.candidate_classes(asked, digests), items, _meta(spark, d))


@query(f"WITH {FILES_SQL}, {DUPLICATES_SQL} SELECT sha1, n FROM dups")
def duplicate_blob_counts(spark, d):
    return report.duplicate_counts(_meta(spark, d))


@query(f"WITH {FILES_SQL}, {DUPLICATES_SQL} SELECT sha1, repo, \"commit\", path, n FROM meta JOIN dups USING (sha1)")
def report_duplicates(spark, d):
    return report.duplicates(cut(_meta(spark, d)))


@query(ORACLE["report_duplicates"])
def report_duplicates_groupby(spark, d):
    places = cut(_meta(spark, d))
    return report.find_by_hash(report.duplicate_counts(places), places).join(report.duplicate_counts(places), "sha1")


@query(f"""WITH {FILES_SQL}, {DUPLICATES_SQL} SELECT sha1, 0 AS kind, sha1 || ' (' || n || ' duplicates)' AS line FROM dups
    UNION ALL SELECT sha1, 1, '  ' || {URL_SQL} FROM meta JOIN dups USING (sha1)""")
def report_text(spark, d):
    return report.duplicate_text(report_duplicates(spark, d))


@query(f"""WITH {FILES_SQL}, {DUPLICATES_SQL} SELECT sha1, '{{"sha":"' || sha1 || '","count":' || any_value(n) || ',"files":[' || string_agg('"' || {URL_SQL} || '"', ',' ORDER BY {URL_SQL}) || ']}}' AS json
    FROM meta JOIN dups USING (sha1) GROUP BY sha1""")
def report_json(spark, d):
    return report.duplicate_json(report_duplicates(spark, d))


@query()
def similar_files_report(spark, d):
    items, _ = written(_items(spark, d, FILE))
    return report.group_report(_communities(engine.members_of_rows(bags_in_rows(items, FILE), FILE)), items.drop("text"), _meta(spark, d), per_content=False)


@query()
def similar_funcs_report(spark, d):
    items, _ = written(_items(spark, d, FUNC))
    return report.group_report(_communities(engine.members_of_rows(bags_in_rows(items, FUNC), FUNC)), items.drop("text"), _meta(spark, d), per_content=True)


@query()
def report_all(spark, d):
    dup = report.with_links(report_duplicates(spark, d).withColumns({"fn_name": F.lit(None).cast("string"), "fn_line": F.lit(None).cast("int")}))
    kinds = (("duplicate", dup.withColumn("community", F.col("sha1"))), ("file", similar_files_report(spark, d)), ("func", similar_funcs_report(spark, d)))
    parts = [rows.select(F.lit(kind).alias("kind"), "community", "item") for kind, rows in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH r AS (SELECT s_suppkey, ['github.com/a/b.git', 'gitlab.com/a/b', 'bitbucket.org/a/b.git', 'file:///tmp/x.git'][(s_suppkey % 4 + 1)::INTEGER] AS repo, 'c' || s_suppkey AS "commit", 'src/' || s_name AS path FROM supplier)
    SELECT s_suppkey, {URL_SQL} AS url FROM r""")
def format_urls(spark, d):
    repos = F.array(*[F.lit(x) for x in ("github.com/a/b.git", "gitlab.com/a/b", "bitbucket.org/a/b.git", "file:///tmp/x.git")])
    rows = _table(spark, d, "supplier").select("s_suppkey", F.element_at(repos, (F.col("s_suppkey") % 4 + 1).cast("int")).alias("repo"),
                                               F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("commit"), F.concat(F.lit("src/"), "s_name").alias("path"))
    return rows.select("s_suppkey", formatting.format_url(F.col("repo"), F.col("commit"), F.col("path")).alias("url"))


ITEMS_SQL = "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'a:b/' || p_partkey || ':fn' || p_size || ':' || p_size ELSE 'a:b/' || p_partkey END AS q FROM part"


@query(f"""WITH t AS ({ITEMS_SQL}) SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN regexp_extract(q, '^(.+):(.+):([0-9]+)$', 1) ELSE q END AS path,
    CASE WHEN p_partkey % 2 = 0 THEN regexp_extract(q, '^(.+):(.+):([0-9]+)$', 2) ELSE '' END AS fn_name, CASE WHEN p_partkey % 2 = 0 THEN regexp_extract(q, '^(.+):(.+):([0-9]+)$', 3)::INTEGER ELSE 0 END AS fn_line FROM t""")
def parse_query_path(spark, d):
    base = F.concat(F.lit("a:b/"), F.col("p_partkey").cast("string"))
    size = F.col("p_size").cast("string")
    q = F.when(F.col("p_partkey") % 2 == 0, F.concat(base, F.lit(":fn"), size, F.lit(":"), size)).otherwise(base)
    return _table(spark, d, "part").select("p_partkey", formatting.parse_query_path(q).alias("x")).select("p_partkey", "x.*").fillna({"fn_name": "", "fn_line": 0})


@query("SELECT p_partkey, md5(p_name) AS sha, replace(p_brand, '#', '_') AS fn_name, p_size::INTEGER AS fn_line FROM part")
def split_func_item(spark, d):
    item = F.concat(F.md5("p_name"), F.lit("_"), F.translate("p_brand", "#", "_"), F.lit(":"), F.col("p_size").cast("string"))
    return _table(spark, d, "part").select("p_partkey", formatting.split_func_item(item).alias("x")).select("p_partkey", "x.*")


@query(f"""WITH {FILES_SQL}, homes AS (SELECT DISTINCT repo, sha1 FROM (SELECT repo, sha1 FROM meta UNION ALL SELECT repo || '-fork', sha1 FROM meta WHERE repo = 'src3')),
    n AS (SELECT sha1, count(*) AS repos FROM homes GROUP BY sha1) SELECT repo, count(*) AS contents FROM homes JOIN n USING (sha1) GROUP BY repo HAVING min(repos) > 1""")
def duplicate_projects(spark, d):
    places = cut(_meta(spark, d))
    fork = places.where("repo = 'src3'").withColumn("repo", F.concat("repo", F.lit("-fork")))
    return report.duplicate_projects(places.unionByName(fork))
