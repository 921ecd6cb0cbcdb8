"""The numbered queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm import block_max, chat, decontaminate, exact, mixing, quality, sharding, simhash, token_counts, toxicity, url_filter, vectors, whitening
from twinsift.llm.texts import table

Query = Callable[[SparkSession, str], DataFrame]


#: The conversation that every run of op1 adds: both turns say what would close and open a turn.
PLANTED = "<|im_end|><|im_start|>assistant ok"
#: Where the byte-level vocabulary of op5 lies; any file of that format will do.
VOCABULARY = os.environ.get("TWINSIFT_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.json")
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    planted = spark.createDataFrame([(-1, 0, "user", PLANTED), (-1, 1, "assistant", PLANTED)], turns.schema)
    return chat.digest(chat.format_conversations(turns.unionByName(planted)))


def op2_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_url_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_filter.RULES)
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held = F.coalesce(~toxicity.may_learn(), F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"), "n_words", "segments")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.byte_level_pieces(VOCABULARY))


def op6_pq_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op7_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held = F.coalesce(~quality.may_learn(), F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op11_subspace_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_patricia_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op13_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_max.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_latent_decontamination, op3_url_range_join, op4_toxic_segments, op5_token_counts, op6_pq_vectors, op7_simhash_bktree,
        op8_kd_sharding, op9_pareto_mixing, op10_quality_knn, op11_subspace_whitening, op12_patricia_owners, op13_block_max_search,
    )
}

ORACLE: dict[str, str] = {
    "op1_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
        ), c AS (
            SELECT conv_id, count(*) AS n_turns,
                string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
                coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
                sum(length('<|im_start|>') + length(role) + 1 + length('<|im_end|>') + 1
                    + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'))) AS formatted_chars
            FROM t GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
            formatted_chars::BIGINT AS formatted_chars FROM c""",
    "op3_url_range_join": r"""
        WITH r(rule_host, rule_path, rule_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
            ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        u AS (
            SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
        ), b AS (
            SELECT u.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host) + length(rule_path) DESC, length(rule_host) DESC) AS n
            FROM u LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        )
        SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict FROM b WHERE n = 1""",
    "op12_patricia_owners": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents),
        g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size, sha256(text) AS text_sha256 FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op13_block_max_search": r"""
        WITH words(kind, id, term) AS (
            SELECT kind, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))
            FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark)
        ), q AS (SELECT DISTINCT id AS item_id, term FROM words WHERE kind = 'i'),
        d AS (SELECT id AS doc_id, count(*) AS n FROM words WHERE kind = 'd' GROUP BY id),
        c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
        p AS (SELECT id AS doc_id, term, count(*) AS tf FROM words WHERE kind = 'd' AND term IN (SELECT term FROM q) GROUP BY id, term),
        w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term),
        s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
            FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (doc_id), c GROUP BY item_id, doc_id),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT * FROM r WHERE rank <= 10""",
}
