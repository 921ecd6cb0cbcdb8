"""Document frequencies and TF-IDF bags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.operators.numbering import order_numbers

COMMON = 50_000  # features whose frequency every task knows

def count_docs(items: DataFrame) -> DataFrame:
    """``docs``: all items count, also those without a feature."""
    return items.agg(F.countDistinct("doc").cast("long").alias("docs"))


def doc_freq(features: DataFrame, once: bool = False) -> DataFrame:
    """``feature, df``.  ``once``: no (feature, doc) has two rows, as ``features.extract`` gives items without a tree."""
    pairs = features.select("feature", "doc")
    return (pairs if once else pairs.distinct()).groupBy("feature").agg(F.count("*").alias("df"))


def term_freq(features: DataFrame) -> DataFrame:
    """``feature, doc, tf``: weights summed as whole numbers."""
    return features.groupBy("feature", "doc").agg(F.sum(F.col("weight").cast("long")).alias("tf"))


def log_tf_log_idf(tf: Column, df: Column, docs: Column, idf: str = "integer") -> Column:
    """``ln(1 + tf) * ln(docs / df)``; by default the quotient is a whole number, so features in over half the documents vanish."""
    ratio = F.floor(docs / df).cast("double") if idf == "integer" else docs / df
    return F.log(1 + tf.cast("double")) * F.log(ratio)


def bags(features: DataFrame, freq: DataFrame, docs: DataFrame, idf: str = "integer", once: bool = False) -> DataFrame:
    """``doc, feature, value`` with value > 0: features without a known frequency and zero weights are left out.

    ``once``: see ``doc_freq``; ``features`` and ``freq`` are tables then, as they are read twice.
    """
    n = F.lit(docs.first()["docs"])
    # Features whose quotient is 1 are worth nothing: they go before the join, not after.
    worth = F.floor(n / F.col("df")) > 1 if idf == "integer" else F.col("df") < n
    if not once:
        known = term_freq(features).join(freq.where(worth), "feature")
    else:
        # The commonest features, worth something or not, are known to every task; only rows of the others are shuffled.
        common = F.broadcast(freq.orderBy(F.desc("df")).limit(COMMON).select("feature", F.col("df").alias("_df")))
        rows = features.select("feature", "doc", F.col("weight").cast("long").alias("tf")).join(common, "feature", "left")
        often = rows.where("_df is not null").withColumnRenamed("_df", "df").where(worth)
        known = often
        if freq.count() > COMMON:
            known = often.unionByName(rows.where("_df is null").drop("_df").join(freq.where(worth), "feature").select(*often.columns))
    return known.select("doc", "feature", log_tf_log_idf(F.col("tf"), F.col("df"), n, idf).alias("value")).where("value > 0")


def vocabulary(freq: DataFrame, per_range: int = 200_000) -> DataFrame:
    """``feature, feature_idx``: place in byte order from 0, numbered range by range."""
    return order_numbers(freq, "feature", "feature_idx", per_range)


def write_json(docs: DataFrame, freq: DataFrame, path: str) -> None:
    """A model as one JSON object in a folder: docs, sorted tokens, df.

    The parts of the folder, one after the other, are the object; each is a range of tokens that one task sorts and
    writes, so there may be any number of tokens.
    """
    n, first = docs.first()["docs"], freq.agg(F.min("feature")).first()[0]
    quoted = F.expr("substring(to_json(array(feature)), 2, length(to_json(array(feature))) - 2)")
    comma = F.when(F.col("feature") == first, "").otherwise(", ")
    rows = freq.select("feature", F.explode(F.array(F.struct(F.lit(1).alias("part"), F.concat(comma, quoted).alias("value")),
                                                    F.struct(F.lit(3).alias("part"), F.concat(comma, quoted, F.lit(": "), F.col("df").cast("string")).alias("value")))).alias("x"))
    frame = [(0, f'{{"docs": {n}, "tokens": ['), (2, '], "df": {'), (4, "}}")]
    fixed = freq.sparkSession.createDataFrame(frame, "part int, value string").select("part", F.lit("").alias("feature"), "value")
    lines = rows.select("x.part", "feature", "x.value").unionByName(fixed)
    lines.repartitionByRange("part", "feature").sortWithinPartitions("part", "feature").select("value").write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(docs, freq) of a JSON model; None if there is none, an error that names a missing key.

    A folder of ``write_json`` is read line by line, each in its own task; a single file is one object, which one task reads.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    if fs.getFileStatus(at).isDirectory():
        lines = spark.read.text(path)
        docs = lines.select(F.regexp_extract("value", r'^\{"docs": (\d+), "tokens": \[$', 1).try_cast("long").alias("docs")).where("docs is not null")
        pair = r'^(?:, )?("(?:[^"\\]|\\.)*"): (\d+)$'
        name = F.get(F.from_json(F.concat(F.lit("["), F.regexp_extract("value", pair, 1), F.lit("]")), "array<string>"), 0)
        return docs, lines.where(F.col("value").rlike(pair)).select(name.alias("feature"), F.regexp_extract("value", pair, 2).try_cast("long").alias("df"))
    found = spark.read.schema("docs long, tokens array<string>, df map<string, long>").json(path, multiLine=True)
    for key, missing in found.select(*(F.col(k).isNull().alias(k) for k in ("docs", "tokens", "df"))).first().asDict().items():
        if missing:
            raise ValueError(f"document frequencies in {path} lack the key {key!r}")
    return found.select("docs"), found.select(F.explode("df").alias("feature", "df"))
