"""The queries that apply each operator of this subpackage to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.llm import alignment, bloom_lm, chat, decontamination, jaccard_join, language_id, licenses, packing, quality, secrets, spelling, token_counts, toxicity

VOCABULARY = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def tokenizer() -> tuple[str, str]:
    """Place of the vocabulary's ranks, and the pattern that cuts pre-tokens."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def pieces() -> str:
    """Place of the second tokenizer's model."""
    import public_tokenizers

    return public_tokenizers.path(PIECES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(table(spark, sf_dir, "documents"), *tokenizer())


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.edit_counts(table(spark, sf_dir, "documents"), *tokenizer())


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digests(secrets.scan(docs, *secrets.learn(docs)))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The arguments of the one tool that plain conversations call.
ANSWER_SCHEMA = [("answer", "question", "string", True), ("answer", "n_words", "integer", True), ("answer", "options", "object", False), ("answer", "options.deep", "boolean", True), ("answer", "options.limits", "array<integer>", False)]


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.calls_from_turns(table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(ANSWER_SCHEMA, "name string, arg string, type string, required boolean")
    return chat.format_calls(calls, results, schemas)


OP8_SQL = r"""
WITH call AS (SELECT DISTINCT ON (conv_id, turn) conv_id, turn, text, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM conversations WHERE role = 'user' ORDER BY conv_id, turn, text),
result AS (SELECT conv_id, turn - 1 AS turn, min(text) AS result, count(*) AS n_results FROM conversations WHERE role = 'assistant' GROUP BY ALL),
chain AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2, turn - 2 * r ORDER BY turn) - 1 AS level, count(*) OVER (PARTITION BY conv_id, turn % 2, turn - 2 * r) AS size
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS r FROM call))
SELECT conv_id, 'call_' || turn AS call_id, CAST(CASE WHEN conv_id % 10 <> 0 OR size = 1 THEN level END AS INTEGER) AS level, turn, coalesce(n_results, 0) AS n_results, length(text) BETWEEN 40 AND 200 AS valid,
    CASE WHEN length(text) < 40 THEN 'type:n_words' WHEN length(text) > 200 THEN 'missing:options.deep' ELSE '' END AS problems,
    '{"arguments":{"n_words":' || CASE WHEN length(text) < 40 THEN '"' || n || '"' ELSE CAST(n AS VARCHAR) END || ',"options":{' || CASE WHEN length(text) <= 200 THEN '"deep":' || CAST(turn % 4 = 0 AS VARCHAR) || ',' ELSE '' END
    || '"limits":[2,' || n || ']},"question":' || to_json(text) || '},"id":"call_' || turn || '","name":"answer"' || CASE WHEN result IS NULL THEN '' ELSE ',"result":' || to_json(result) END || '}' AS json
FROM call JOIN chain USING (conv_id, turn) LEFT JOIN result USING (conv_id, turn)
"""


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH fold AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i:i + 9] AS t, array_to_string(w[i:i + 9], ' ') AS p FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
place AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM fold), (SELECT DISTINCT n FROM win) WHERE i + n - 1 <= len(w)),
hit AS (SELECT r, i, n, item_id FROM place JOIN win USING (n, p)),
word AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r),
term AS (SELECT x, count(*) AS df FROM (SELECT unnest(w) AS x FROM fold) GROUP BY x),
lead AS (SELECT p, n, t, arg_min(x, df) AS x FROM (SELECT DISTINCT p, n, t, unnest(t) AS x FROM win) JOIN term USING (x) GROUP BY p, n, t),
spot AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM fold),
near AS (SELECT DISTINCT r, p FROM (SELECT r, p, n, t, w, i, unnest(range(greatest(i - n - 1, 1), i + 1)) AS s FROM spot JOIN lead ON x = w[i])
    WHERE len(list_filter(t, lambda a: len(list_filter(w[s:s + n + 1], lambda b: b = a)) < len(list_filter(t, lambda b: b = a)))) = 0),
close AS (SELECT r, count(DISTINCT item_id) AS n_near FROM near JOIN win USING (p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM fold LEFT JOIN word USING (r) LEFT JOIN found USING (r) LEFT JOIN close USING (r)
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.scores(table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_digests(table(spark, sf_dir, "documents"), *tokenizer(), pieces())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_toxicity": op2_toxicity,
        "op3_token_counts": op3_token_counts,
        "op4_benchmark_decontamination": op4_benchmark_decontamination,
        "op5_secret_scans": op5_secret_scans,
        "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
        "op7_quality_rules": op7_quality_rules,
        "op8_chat_formatting": op8_chat_formatting,
        "op9_license_scans": op9_license_scans,
        "op10_language_id": op10_language_id,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_lm_scores": op12_lm_scores,
        "op13_tokenizer_alignment": op13_tokenizer_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_benchmark_decontamination": OP4_SQL, "op8_chat_formatting": OP8_SQL, "op9_license_scans": licenses.oracle_sql(), "op11_spelling_variants": spelling.oracle_sql()}
