import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsift.functions import stemming
from twinsift.operators import communities, counting, docfreq, features, lsh, numbering, wmh
from twinsift.operators.components import connected_components


def union_find(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        up[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none"])
def test_components_are_the_closure(spark, kind):
    rng = random.Random(3)
    edges = {
        "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(40)],
        "chain": [(i, i + 1) for i in range(80)],
        "star": [(0, i) for i in range(1, 50)] + [(100, 101)],
        "none": [],
    }[kind]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges + [(5, 5)] + [(None, 1)], "u long, v long")).collect()}
    assert got == {k: v for k, v in union_find([e for e in edges if e[0] != e[1]]).items()}


def test_components_of_strings(spark):
    got = connected_components(spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "u string, v string")).collect()
    assert {r["node"]: r["component"] for r in got} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_slots_are_gapless(spark):
    rows = [(i % 3, i // 2) for i in range(200)]
    got = numbering.gapless_slots(spark.createDataFrame(rows, "g int, k long"), "g", ["k"], "slot", rows_per_bucket=16).collect()
    for g in range(3):
        slots = sorted(r["slot"] for r in got if r["g"] == g)
        assert slots == list(range(len(slots)))
    assert len(got) == 200


def test_order_numbers_have_null_last(spark):
    values = spark.createDataFrame([(v,) for v in ("b", None, "", "é", "a", "Z")], "v string")
    for per_range in (2, 100):
        got = numbering.order_numbers(values, "v", "n", per_range).collect()
        assert [r["v"] for r in sorted(got, key=lambda r: r["n"])] == ["", "Z", "a", "b", "é", None] and {r["n"] for r in got} == set(range(6))


def test_features(spark):
    items = spark.createDataFrame([("d", 'getHTTP fooBar foo_bar 12 "x y" 12'), ("e", "")], "doc string, text string")
    ids = {(r["feature"], r["weight"]) for r in features.identifiers(items, 10).collect()}
    assert ("i.foo", 20) in ids and ("i.bar", 20) in ids and ("i.http", 10) in ids
    assert sorted(r["weight"] for r in features.literals(items, 1).collect()) == [1, 2]
    words = spark.createDataFrame([("d", "a b c d e")], "doc string, text string")
    assert {r["feature"] for r in features.sequences(words, 1, (3,), 2).collect()} == {"s.a>b>c", "s.c>d>e"}


def test_stems():
    known = {"consumer": "consum", "consumers": "consum", "notifiers": "notifi", "running": "run", "relational": "relat", "conditional": "condit", "hopefulness": "hope", "adoption": "adopt",
             "replacement": "replac", "electriciti": "electr", "controlling": "control", "generalizations": "gener", "oscillators": "oscil", "probate": "probat", "happily": "happili", "agreed": "agreed", "queues": "queues",
             "flattening": "flatten", "filings": "file", "été": "été", "x" * 9: "x" * 9, "": ""}
    assert {w: stemming.stem(w) for w in known} == known


def test_identifiers_by_stem_and_frequency(spark):
    items = spark.createDataFrame([("d", "consumeQueue Consumers running_consumer"), ("e", "consumer"), ("f", "")], "doc string, text string")
    got = {(r["doc"], r["feature"]): r["weight"] for r in features.identifiers(items, 10, stem=True).collect()}
    assert got == {("d", "i.consum"): 30, ("d", "i.queue"): 10, ("d", "i.run"): 10, ("e", "i.consum"): 10}
    found = features.identifiers(items, 10, stem=True)
    assert {(r["doc"], r["feature"]) for r in features.frequent(found, 2).collect()} == {("d", "i.consum"), ("e", "i.consum")}
    assert features.frequent(found, 1) is found and features.frequent(found, 3).count() == 0


def test_graphlets(spark):
    nodes = spark.createDataFrame([("d", 0, None, "File"), ("d", 1, 0, "B"), ("d", 2, 0, "A")], "doc string, node_id long, parent_id long, internal_type string")
    assert {r["feature"]: r["weight"] for r in features.graphlets(nodes, 5).collect()} == {"g.None_File_A_B": 5, "g.File_A": 5, "g.File_B": 5}


def bag_rows(seed=1, docs=30):
    rng = random.Random(seed)
    return [(f"f{rng.randrange(40)}", f"d{d}", rng.randrange(1, 9)) for d in range(docs) for _ in range(12)]


def test_tfidf_against_the_formula(spark):
    rows = bag_rows()
    found = spark.createDataFrame(rows, "feature string, doc string, weight long")
    got = {(r["doc"], r["feature"]): r["value"] for r in docfreq.bags(found, docfreq.doc_freq(found), docfreq.count_docs(found)).collect()}
    tf, docs_of = {}, {}
    for f, d, w in rows:
        tf[d, f] = tf.get((d, f), 0) + w
        docs_of.setdefault(f, set()).add(d)
    want = {k: math.log(1 + v) * math.log(30 // len(docs_of[k[1]])) for k, v in tf.items() if 30 // len(docs_of[k[1]]) > 1}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_vocabulary_is_ordered(spark):
    freq = spark.createDataFrame([(f"{i:03d}", 1) for i in range(100)], "feature string, df long")
    got = docfreq.vocabulary(freq, per_range=7).collect()
    assert sorted((r["feature"], r["feature_idx"]) for r in got) == [(f"{i:03d}", i) for i in range(100)]


def test_docfreq_json(spark, tmp_path):
    """A folder whose parts make one object, and single files of others."""
    names = ["b", "a", 'q"uote', "back\\slash", "new\nline", "é\u2028", "", "x: 1", "[", "z" * 300]
    docs, freq = spark.createDataFrame([(3,)], "docs long"), spark.createDataFrame([(f, i + 1) for i, f in enumerate(names)], "feature string, df long")
    path = tmp_path / "m.json"
    docfreq.write_json(docs, freq.repartition(4), str(path))
    whole = json.loads("".join(p.read_text() for p in sorted(path.glob("part-*"))))
    assert whole == {"docs": 3, "tokens": sorted(names), "df": {f: i + 1 for i, f in enumerate(names)}}
    (tmp_path / "one.json").write_text(json.dumps(whole))
    for of in (path, tmp_path / "one.json"):
        got = docfreq.read_json(spark, str(of))
        assert [r["docs"] for r in got[0].collect()] == [3] and sorted(map(tuple, got[1].collect())) == sorted(whole["df"].items())
    docfreq.write_json(docs, freq.limit(0), str(tmp_path / "none"))
    got = docfreq.read_json(spark, str(tmp_path / "none"))
    assert got[0].first()["docs"] == 3 and got[1].count() == 0
    assert docfreq.read_json(spark, str(tmp_path / "missing.json")) is None
    (tmp_path / "bad.json").write_text('{"docs": 1, "tokens": []}')
    with pytest.raises(ValueError, match="df"):
        docfreq.read_json(spark, str(tmp_path / "bad.json"))


def test_a_band_that_a_third_of_the_items_have_is_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(lsh, "BLOCK", 16)
    rows = [(0, "hot", f"h{i:03d}") for i in range(200)] + [(t, f"v{i // 2}", f"d{i}") for t in range(2) for i in range(200)]
    index = spark.createDataFrame(rows, "hashtable int, value string, doc string")
    asked = index.where("doc like '%5' or value = 'hot'")
    got = sorted(map(tuple, lsh.candidates(asked, index).collect()))
    of = {}
    for t, v, d in rows:
        of.setdefault((t, v), []).append(d)
    assert got == sorted({(q, d) for t, v, q in rows if q.endswith("5") or v == "hot" for d in of[t, v]})
    left, right = lsh.dealt(asked, index.withColumnRenamed("doc", "other"), ["hashtable", "value"])
    sizes = sorted(r["count"] for side in (left, right) for r in side.groupBy("hashtable", "value", "_l", "_r").count().collect())
    assert sizes[-1] <= 40  # the hot band alone has 200 on either side
    pairs = {(r["a"], r["b"]): r["bands"] for r in lsh.quadratic_edges(index).collect()}
    assert len(pairs) == 200 * 199 // 2 + 100 and pairs["d0", "d1"] == 2


def test_signatures_agree_with_the_column_form_and_ignore_order(spark):
    found = spark.createDataFrame(bag_rows(), "feature string, doc string, weight long")
    bags = docfreq.bags(found, docfreq.doc_freq(found), docfreq.count_docs(found)).cache()
    fast = {(r["doc"], r["s"]): (r["k"], r["t"]) for r in wmh.long_form(wmh.signatures(bags, 16)).collect()}
    slow = {(r["doc"], r["s"]): (r["k"], r["t"]) for r in wmh.signatures_sql(bags, 16).collect()}
    assert fast == slow
    turned = wmh.long_form(wmh.signatures(bags.orderBy("value"), 16)).collect()
    assert {(r["doc"], r["s"]): (r["k"], r["t"]) for r in turned} == fast


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    x = rng.choice(wmh.P, 200, replace=False)
    v, w = rng.random(200) + 0.1, None
    w = v * rng.choice([1.0, 1.0, 0.3], 200)
    a, b = wmh.constants(2000)
    first, second = wmh.signature_of(x, v, a, b), wmh.signature_of(x, w, a, b)
    same = ((first[0] == second[0]) & (first[1] == second[1])).mean()
    assert abs(same - np.minimum(v, w).sum() / np.maximum(v, w).sum()) < 0.05


def test_band_values(spark):
    df = spark.createDataFrame([("d", [1, 2], [0, -1])], "doc string, ks array<long>, ts array<long>")
    assert [tuple(r) for r in wmh.bands(df, 2, 1).collect()] == [("d", 0, "0100000000000000"), ("d", 1, "02000000ffffffff")]


def test_queries_build_whole_signatures_of_both_modes(spark):
    from twinsift.config import FILE, FUNC
    from twinsift.plans import queries

    small = "/root/testdata/sf0.001"
    bags = queries._bags(spark, small, FUNC).where("crc32(encode(doc, 'UTF-8')) % 7 = 0").localCheckpoint()
    signed = {r["doc"]: list(zip(r["ks"], r["ts"])) for r in wmh.signatures(bags, FUNC.samples).collect()}
    found = {(r["doc"], r["hashtable"]): r["value"] for r in queries.hashtables_func(spark, small).join(bags.select("doc").distinct(), "doc").collect()}
    assert len(signed) > 20 and set(found) == {(d, i) for d in signed for i in range(FUNC.tables)}
    for d, pairs in signed.items():
        for i in range(FUNC.tables):
            assert found[d, i] == "".join((x % 2**32).to_bytes(4, "little").hex() for pair in pairs[i * FUNC.band : (i + 1) * FUNC.band] for x in pair)
    assert sorted(r["hashtable"] for r in queries.list_hashtables(spark, small).collect()) == list(range(FILE.tables))


def test_band_parameters():
    assert lsh.band_parameters(0.8, 128) == (9, 13)
    assert lsh.band_parameters(0.6456707644812872, 160) == (20, 8)
    assert lsh.band_parameters(0.592, 256) == (32, 8)


def test_band_parameters_of_a_table(spark):
    cases = [(0.8, 128), (0.6456707644812872, 160), (0.592, 256), (0.5, 1), (0.3, 17), (0.9, 40), (0.0, 5), (1.0, 5)]
    odd = [(None, 5), (0.5, None), (0.5, 0), (0.5, -3), (1.5, 4), (-0.1, 4), (float("nan"), 4)]
    df = spark.createDataFrame([(*c, "x") for c in cases * 3 + odd], "threshold double, samples int, band string")
    got = {(r["threshold"], r["samples"]): (r["tables"], r["band"]) for r in lsh.best_bands(df).collect()}
    assert got.keys() == set(cases) and lsh.best_bands(df.limit(0)).count() == 0
    assert all(got[c] == lsh.band_parameters(*c) for c in cases if 0 < c[0] < 1)


def test_a_count_is_exact_when_all_tasks_end(spark):
    df = spark.range(0, 10_007, 1, 5).where("id % 3 = 0")
    found = counting.approximate_count(df, 120)
    assert found == counting.Count(3336, 3336, 3336, True) and str(found) == "3336"
    assert counting.approximate_count(df.limit(0), 120) == counting.approximate_count(spark.createDataFrame([], "n long"), 120) == counting.Count(0, 0, 0, True)
    assert counting.approximate_count(df.groupBy("id").count(), 120).n == 3336
    for seconds, confidence in ((0, 0.9), (1, 0.0), (1, 1.0)):
        with pytest.raises(ValueError, match="confidence"):
            counting.approximate_count(df, seconds, confidence)


def test_bounds_of_a_count_hold_as_often_as_they_say():
    rng = random.Random(2)
    held = 0
    for _ in range(400):
        sizes = [rng.randrange(1000) for _ in range(60)]
        ended = rng.sample(sizes, 12)
        found = counting.scaled_up(12, sum(ended), sum(x * x for x in ended), 60, 0.9)
        assert sum(ended) <= found.low <= found.n <= found.high
        held += found.low <= sum(sizes) <= found.high
    assert 0.85 < held / 400 < 0.95
    assert counting.scaled_up(0, 0, 0, 3, 0.9) == counting.Count(0, 0, None, False)
    assert counting.scaled_up(1, 7, 49, 3, 0.9) == counting.Count(21, 7, None, False)


def test_a_count_that_fails_says_so(spark):
    def bad(batches):
        for _ in batches:
            raise RuntimeError("no such row")
        yield

    with pytest.raises(Exception, match="no such row"):
        counting.approximate_count(spark.range(10).mapInPandas(bad, "id long"), 120)


def test_a_count_in_time_has_bounds_and_ends_the_job(spark):
    def slow(batches):
        for batch in batches:
            if batch["id"].max() >= 1900:
                time.sleep(90)
            yield batch

    df = spark.range(0, 2000, 1, 20).mapInPandas(slow, "id long")
    began = time.time()
    found = counting.approximate_count(df, 12)
    assert time.time() - began < 60
    assert not found.exact and found.low <= found.n and (found.high is None or found.n <= found.high)
    assert found.high is not None and found.low <= 2000 <= found.high  # 19 tasks of 100 rows have ended
    assert str(found).startswith("about ")
    waited = time.time()
    while spark.sparkContext.statusTracker().getActiveJobsIds():
        assert time.time() - waited < 20
        time.sleep(0.2)


def bands(spark):
    rows = [(0, "v1", "a"), (0, "v1", "b"), (0, "v2", "c"), (0, "v3", "d"), (0, "v4", "e"), (1, "w1", "d"), (1, "w1", "e"), (1, "w2", "a"), (2, "x", "b"), (2, "x", "c")]
    return spark.createDataFrame(rows, "hashtable int, value string, doc string")


def test_buckets_components_communities(spark):
    members = lsh.buckets(bands(spark))
    assert {(r["hashtable"], r["doc"]) for r in members.collect()} == {(0, "a"), (0, "b"), (1, "d"), (1, "e"), (2, "b"), (2, "c")}
    parts = connected_components(lsh.star_edges(members))
    assert {r["node"]: r["component"] for r in parts.collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    found = communities.communities(lsh.linear_edges(members), parts).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["community"], set()).add(r["element"])
    assert {"d", "e"} in groups.values() and set().union(*groups.values()) == set("abcde")
    assert all(c == min(g) for c, g in groups.items())


def test_walktrap_splits_two_cliques():
    clique = lambda at: [(at + i, at + j, 1.0) for i in range(5) for j in range(i)]
    found = communities.walktrap(10, clique(0) + clique(5) + [(0, 5, 1.0)])
    assert len(set(found[:5])) == len(set(found[5:])) == 1 and found[0] != found[5]


def test_shared_bands_are_found_by_hashes_alone(spark):
    rng = random.Random(5)
    rows = [(f"f{rng.randrange(40)}", f"d{d}", 1 + rng.randrange(3)) for d in range(60) for _ in range(1 + d % 6)]
    rows += [(f, f"{d}copy", w) for f, d, w in rows if d in ("d7", "d11")]
    found = spark.createDataFrame(rows, "feature string, doc string, weight long")
    bags = docfreq.bags(found, docfreq.doc_freq(found), docfreq.count_docs(found)).cache()
    plain = lsh.buckets(wmh.bands(wmh.signatures(bags, 32), 16, 2))
    got = lsh.buckets_of_bags(wmh.packed(bags).cache(), 32, 16, 2)
    rows_of = lambda df: sorted((r["hashtable"], r["value"], r["doc"]) for r in df.collect())
    assert rows_of(got) == rows_of(plain) and got.count() > 32
    shuffled = wmh.digests(wmh.packed(bags), 32, 16, 2)
    assert "value" not in shuffled.columns and shuffled.select("hashtable", "h").distinct().count() == wmh.bands(wmh.signatures(bags, 32), 16, 2).select("hashtable", "value").distinct().count()


def test_names_are_counted_where_their_item_lies(spark):
    items = spark.createDataFrame([("a", "two Two one 7 7"), ("b", ""), ("c", "x")], "doc string, text string")
    found = features.extract(items, features_mode())
    assert {(r["doc"], r["feature"], r["weight"]) for r in found.collect()} >= {("a", "i.two", 2 * 194), ("a", "i.one", 194), ("c", "i.x", 194)} and found.where("doc = 'a'").count() == 3
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def features_mode():
    from twinsift.config import FILE

    return FILE


def test_nodes_are_never_broadcast(spark):
    nodes = spark.createDataFrame([("d", 0, None, "File"), ("d", 1, 0, "A")], "doc string, node_id long, parent_id long, internal_type string")
    assert "BroadcastHashJoin" not in features.graphlets(nodes, 5)._jdf.queryExecution().executedPlan().toString()


def test_bags_with_and_without_common_features_are_equal(spark, monkeypatch):
    rng = random.Random(3)
    rows = sorted({(f"f{int(rng.random() ** 2 * 30)}", f"d{d}") for d in range(40) for _ in range(5)})
    found = spark.createDataFrame([(f, d, 2) for f, d in rows], "feature string, doc string, weight long").cache()
    docs, freq = docfreq.count_docs(found), docfreq.doc_freq(found)
    monkeypatch.setattr(docfreq, "COMMON", 4)
    plain, split = (sorted(map(tuple, docfreq.bags(found, f, docs, once=o).collect())) for f, o in ((freq, False), (docfreq.doc_freq(found, once=True), True)))
    assert plain == split and plain


def test_rounds_of_components_are_written_tables(spark):
    """What a checkpoint remembers of partitionings multiplies with every round, until planning no longer ends."""
    n = 100
    edges = spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    found = connected_components(edges)
    assert found.inputFiles() and found.where("component = 0").count() == n


def test_the_column_form_draws_samples_row_by_row_once_a_bag_has_met(spark):
    rows = [("long", f"f{i}", 0.1 + i % 7) for i in range(3000)] + [(f"d{i}", f"f{j}", 0.5 + j) for i in range(20) for j in range(i + 1)]
    bags = spark.createDataFrame(rows, "doc string, feature string, value double").repartition(3, "feature").localCheckpoint()
    found = wmh.signatures_sql(bags, 16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert "Aggregate" not in plan.split("Exchange hashpartitioning")[1]  # the rows themselves move, not what is drawn of them
    want = wmh.long_form(wmh.signatures(bags, 16)).collect()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want)) and len(want) == 21 * 16
