import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsift.config import FILE, FUNC
from twinsift.operators import bags, docfreq, features, lsh, wmh
from twinsift.sources import files


@pytest.mark.parametrize("mode", [FILE, FUNC, replace(FUNC, least_docs=3)], ids=["file", "func", "frequent"])
def test_bags_in_rows_are_those_of_joins_over_parts_of_any_size(spark, monkeypatch, mode):
    monkeypatch.setattr(bags, "PART", 400)
    rng = random.Random(5)
    words = [rng.choice("abcdefg") * rng.randrange(1, 4) for _ in range(40)]
    texts = [" ".join(rng.choice(words) + str(rng.randrange(9)) for _ in range(rng.randrange(30))) for _ in range(60)] + ["", "x", "Éa 12 \"q\"", "everywhere " * 2000]
    items = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc string, text string").repartition(3)
    found = features.extract(items, mode).cache()
    rows = docfreq.bags(found, docfreq.doc_freq(found), docfreq.count_docs(items))
    want = {(r["doc"], r["feature"]): r["value"] for r in rows.collect()}
    got = bags.bags_in_rows(items, mode, named=True).collect()
    assert len(got) == len({r["doc"] for r in got}) and all(len(r["x"]) > 0 for r in got)
    assert {(r["doc"], f): v for r in got for f, v in zip(r["feature"], r["v"])} == pytest.approx(want, rel=1e-14)
    packed = {r["doc"]: sorted(zip(r["x"], r["v"])) for r in wmh.packed(rows).collect()}
    assert {r["doc"]: sorted(zip(r["x"], map(pytest.approx, r["v"]))) for r in got} == packed


def test_no_row_per_feature_is_shuffled_by_document(spark):
    items = spark.createDataFrame([(f"d{i}", "one two three four five") for i in range(9)] + [("e", "six seven")], "doc string, text string")
    plan = bags.bags_in_rows(items, FILE)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc" not in plan and "hashpartitioning(feature" not in plan


def test_first_places_of_copies_are_found_without_moving_contents(spark):
    rows = [(repo, path, text) for repo, path, text in [(None, "a", "x"), ("r2", "b", "x"), ("r1", "c", "x"), (None, "d", "y"), (None, "e", "y"), ("r1", "f", "z"), ("r1", "f", "z"), ("r3", "g", "w")]]
    found = files.distinct_blobs(spark.createDataFrame(rows, "repository_id string, path string, content string").select("*", F.lit("h").alias("commit_hash"), F.sha1("content").alias("blob_id")))
    assert sorted((r["content"], r["repository_id"], r["path"]) for r in found.collect()) == [("w", "r3", "g"), ("x", "r1", "c"), ("y", None, "d"), ("z", "r1", "f")]
    few = files.distinct_blobs(spark.range(1000).select(F.lit("r").alias("repository_id"), F.col("id").cast("string").alias("path"), F.lit("h").alias("commit_hash"), F.lit("t").alias("content"), (F.col("id") % 990).alias("blob_id")))
    assert few.count() == 990 and "hashpartitioning" not in few._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("known", [0, 10**6])
def test_lookups_and_buckets_by_digests_are_those_by_values(spark, monkeypatch, known):
    monkeypatch.setattr(lsh, "KNOWN", known)
    monkeypatch.setattr(lsh, "FEW", known)
    rows = spark.createDataFrame([(f"d{i}", [1 + i // 3, 50, 70 + i % 2], [1.0, 2.0, 0.5]) for i in range(24)], "doc string, x array<long>, v array<double>")
    digests = wmh.digests_in_rows(rows, 16, 8, 2).cache()
    bands = wmh.bands_of_packed(rows, 16, 8, 2).cache()
    asked = rows.select("doc").where("doc in ('d0', 'd7')")
    pairs = lambda found: sorted(map(tuple, found.collect()))
    want = pairs(lsh.candidates(bands.join(asked, "doc"), bands))
    assert len(want) > 2 and pairs(lsh.candidates_of_digests(asked, digests)) == want
    assert pairs(lsh.quadratic_edges(lsh.members_of_digests(digests), lsh.DIGEST)) == pairs(lsh.quadratic_edges(lsh.buckets(bands)))


def test_samples_of_long_bags_are_drawn_only_where_bounds_leave_a_chance(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 150, 60)
    x, value = rng.integers(0, wmh.P, sizes.sum()), rng.exponential(3.0, sizes.sum()) + 1e-3
    x[:2], x[-3:], value[-3:] = (0, wmh.P - 1), 5, 1.0  # ends of the range, and ties
    a, b = wmh.constants(64)
    cells, drawn, draw = 64 * len(x), [], wmh._drawn
    monkeypatch.setattr(wmh, "_drawn", lambda x, a, b: drawn.append(np.broadcast(x, a).size) or draw(x, a, b))
    got = wmh.signatures_of(x, value, sizes, a, b)
    assert sum(drawn) < 5 * cells / 2
    monkeypatch.setattr(wmh, "BOUNDED", 10**9)
    assert all((g == w).all() for g, w in zip(got, wmh.signatures_of(x, value, sizes, a, b)))
    assert all(np.array([wmh.signature_of(x[e - n : e], value[e - n : e], a, b)[i] for e, n in zip(np.cumsum(sizes), sizes)] == got[i]).all() for i in (0, 1))


def test_frequencies_travel_as_long_rows(spark):
    items = spark.createDataFrame([(f"d{i}", f"one two three four five w{'abc'[i % 3]}") for i in range(9)], "doc string, text string")
    rows = bags.bags_in_rows(items, FUNC)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bucket" in plan and "hashpartitioning(h" not in plan and rows.count() == 9


def test_hashed_names_count_what_names_count(spark):
    items = spark.createDataFrame([("a", "x y x y x 12 \"q\" 12"), ("b", ""), ("c", "No oNe")], "doc string, text string")
    for mode in (FILE, FUNC):
        got = spark.createDataFrame(features.hashed(items, mode).select("doc", F.size("hs").alias("n"), F.aggregate("ns", F.lit(0), lambda a, n: a + n).alias("m"), F.size(F.array_distinct("hs")).alias("k")).collect())
        want = features.counted(items, mode).select("doc", F.size("f").alias("k")).collect()
        assert {r["doc"]: r["k"] for r in got.collect()} == {r["doc"]: r["k"] for r in want} and got.where("n <> m").isEmpty()


def test_copies_are_looked_up_as_one_class(spark):
    rows = spark.createDataFrame([(f"d{i}", [1, 2, 3], [1.0, 2.0, 0.5]) for i in range(6)] + [("e", [1, 2, 9], [1.0, 2.0, 0.5]), ("f", [8], [1.0])], "doc string, x array<long>, v array<double>")
    digests = wmh.digests_in_rows(rows, 16, 8, 2).cache()
    found, members = lsh.candidate_classes(rows.select("doc").where("doc < 'd3'"), digests)
    classes = members.groupBy(*lsh.CLASS).agg(F.sort_array(F.collect_list("doc")).alias("docs"))
    assert sorted(r["docs"] for r in classes.collect()) == [[f"d{i}" for i in range(6)], ["e"]]
    assert found.count() == 3 * 2 and found.select(*lsh.CLASS).distinct().count() == 2


def test_features_of_few_documents_are_left_out_where_their_item_lies(spark, monkeypatch):
    monkeypatch.setattr(bags, "PART", 60)
    rng = random.Random(8)
    items = spark.createDataFrame([(f"d{i}", " ".join(rng.choice(["aa", "Bb", "cC", "dd", f"e{i % 7}", "\"q\""]) for _ in range(rng.randrange(12)))) for i in range(40)] + [("none", "")], "doc string, text string")
    for mode in (replace(FILE, least_docs=5), replace(FUNC, least_docs=2)):
        found = bags.frequent_features(items, mode)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(feature" not in plan and "hashpartitioning(doc" not in plan
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, features.extract(items, mode).collect()))
