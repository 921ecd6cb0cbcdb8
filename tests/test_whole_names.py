from dataclasses import replace

import pytest

from twinsift.config import FILE, FUNC
from twinsift.operators import bags, features
from twinsift.plans import queries
from twinsift.plans.queries import QUERIES
from twinsift.sources import pages


def test_graphlets_of_any_width_are_kept(spark, tmp_path):
    html = "<div>" + "<p></p>" * 40_000 + "</div><p>AT&T"
    spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = {r["feature"]: r["weight"] // FILE.graphlet for r in QUERIES["feat_graphlet"](spark, str(tmp_path)).collect()}
    wide = "g.document_div" + "_p" * 40_000
    assert found == {"g.None_document_div_p": 1, wide: 1, "g.div_p": 40_000, "g.document_p_text": 1, "g.p_text": 1}


def test_the_end_of_a_page_is_read(spark):
    nodes = pages.nodes(spark.createDataFrame([(1, "<p>x</p>AT&T"), (2, "<p>a&lt")], "page_id long, html string")).collect()
    assert [(r["doc"], r["token"]) for r in nodes if r["internal_type"] == "text"] == [("1", "x"), ("1", "AT&T"), ("2", "a<")]


def test_names_of_any_length_are_features(spark):
    long = "b" * 70_000
    items = spark.createDataFrame([("d", f"{long} x y"), ("e", f"{long} z")], "doc string, text string")
    assert {r["feature"] for r in features.extract(items, FUNC).where("length(feature) > 65530").collect()} == {f"i.{long}", f"s.{long}>x>y"}
    found = bags.bags_in_rows(items, replace(FUNC, sequences=None), named=True).collect()
    assert {f for r in found for f in r["feature"]} == {"i.x", "i.y", "i.z"}
    assert len(features.distinct_hashes(items, FUNC).where("doc = 'd'").first()["hs"]) == 4


@pytest.mark.parametrize("name", ["similar_files_report", "similar_funcs_report"])
def test_reports_read_their_items_once(spark, tmp_path, monkeypatch, name):
    spark.createDataFrame([(1, "one two " * 100, "en", "r")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    calls, items = [], queries._items
    monkeypatch.setattr(queries, "_items", lambda *a: calls.append(a) or items(*a))
    monkeypatch.setattr(queries.engine, "members_of_rows", lambda rows, mode: rows)
    monkeypatch.setattr(queries, "_communities", lambda rows: spark.createDataFrame([], "community string, element string"))
    QUERIES[name](spark, str(tmp_path))
    assert len(calls) == 1
