import glob
import os

import duckdb
import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"
HEAVY = {"wmh_signature", "hashtables_file", "query_similar", "similar_pairs", "query_similar_candidates"}


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted((tuple(round(float(x), 6) if isinstance(x, float) else x for x in r) for r in frame.itertuples(index=False)), key=str)


def core_names():
    from twinsift.plans import queries as core

    return sorted(core.ORACLE.keys() - HEAVY)


@pytest.mark.parametrize("name", core_names())
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = __spark_entry__.queries()[name](spark, SMALL).toPandas(), con.execute(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert [tuple(map(str, r)) for r in rows(got)] == [tuple(map(str, r)) for r in rows(want)]


def small_names():
    from twinsift.plans import queries as core

    return sorted(core.SMALL_SQL.keys() | HEAVY)


@pytest.mark.parametrize("name", small_names())
def test_heavy_query_equals_its_sql_on_a_few_documents(spark, tmp_path, name):
    from twinsift.plans import queries as core

    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT * FROM '{SMALL}/documents.parquet' WHERE length(text) < 1500 ORDER BY doc_id LIMIT 30")
    con.execute("INSERT INTO documents SELECT 1000 + doc_id, text || ' end', lang, source, n_chars + 4 FROM documents LIMIT 8")
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    sql = core.SMALL_SQL.get(name) or core.ORACLE[name]
    got, want = core.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(sql).df()
    assert len(got) and [tuple(map(str, r)) for r in rows(got)] == [tuple(map(str, r)) for r in rows(want)]


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns
