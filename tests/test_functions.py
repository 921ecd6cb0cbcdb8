import hashlib

from pyspark.sql import functions as F

from twinsift.functions import formatting, hashing


def test_uint32_wraps_and_is_little_endian(spark):
    cases = {0: "00000000", 1: "01000000", 12345: "39300000", 2**32 - 1: "ffffffff", 2**32: "00000000", 2**32 + 1: "01000000", -1: "ffffffff"}
    rows = spark.createDataFrame([(k,) for k in cases], "n long").select("n", hashing.uint32_le(F.col("n")).alias("h")).collect()
    assert {r["n"]: r["h"] for r in rows} == cases


def test_git_blob_sha1_is_gits(spark):
    texts = ["", "hello\n", "é" * 300]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashing.git_blob_sha1(F.encode("t", "UTF-8")).alias("h")).collect()
    for r in rows:
        raw = r["t"].encode()
        assert r["h"] == hashlib.sha1(b"blob %d\0" % len(raw) + raw).hexdigest()


def test_hex_with_separator(spark):
    row = spark.range(1).select(hashing.bytes2hex(F.unhex(F.lit("0aFF10"))).alias("a"), hashing.bytes2hex(F.unhex(F.lit("0aFF10")), ":").alias("b")).first()
    assert (row["a"], row["b"]) == ("0aff10", "0a:ff:10")


def test_urls(spark):
    cases = {
        ("github.com/x/y.git", "c", "p"): "https://github.com/x/y/blob/c/p",
        ("gitlab.com/x/y", "c", "p"): "https://gitlab.com/x/y/blob/c/p",
        ("bitbucket.org/x/y.git", "c", "p"): "https://bitbucket.org/x/y/src/c/p",
        ("/home/x.git", "c", "p"): "repo: /home/x commit: c path: p",
    }
    df = spark.createDataFrame(list(cases), "r string, c string, p string")
    rows = df.select("*", formatting.format_url(F.col("r"), F.col("c"), F.col("p")).alias("u")).collect()
    assert {(r["r"], r["c"], r["p"]): r["u"] for r in rows} == cases


def test_query_path_and_item(spark):
    df = spark.createDataFrame([("a/b.go:f:7",), ("c:d.go",), ("x:y:z:12",)], "q string").select(formatting.parse_query_path(F.col("q")).alias("x")).select("x.*")
    assert [tuple(r) for r in df.collect()] == [("a/b.go", "f", 7), ("c:d.go", None, None), ("x:y", "z", 12)]
    row = spark.createDataFrame([("abc_my_fn:3",)], "q string").select(formatting.split_func_item(F.col("q")).alias("x")).select("x.*").first()
    assert tuple(row) == ("abc", "my_fn", 3)
