"""Queries of this package: each maps the given tables to an operator and its result back."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popstat.llm.alignment import align_log_tokens
from popstat.llm.main_text import extract_main_text
from popstat.llm.minhash import edited_log_likeness
from popstat.llm.outliers import judge_logs
from popstat.llm.recompression import remove_repeated_passages
from popstat.llm.replication import replicate_haplotypes, tempered_weights
from popstat.llm.requests import link_requests
from popstat.llm.simhash import near_duplicate_logs
from popstat.llm.spelling import log_words, spelling_variants
from popstat.llm.templates import with_quotations
from popstat.llm.token_counts import log_token_counts
from popstat.llm.toxicity import fit_on_labels, held_out, score_toxicity
from popstat.llm.wavelet import read_packed_population, texts_as_ids, unpack_population, write_packed_population
from popstat.session import scratch_path, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can express it."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return build(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def documents_as_logs(spark: SparkSession, folder: str) -> DataFrame:
    """The documents table with the names of captured run output."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    return documents.select(F.col("doc_id").alias("run_id"), F.col("text").alias("log"))


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = log_token_counts(documents_as_logs(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumnRenamed("run_id", "doc_id")


@query("op2_robust_outliers")
def op2_robust_outliers(spark: SparkSession, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    judged = judge_logs(documents, ("lang", "source"), "doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *names)


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    model = fit_on_labels(documents, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = score_toxicity(documents.select("doc_id", held_out().alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


#: Sources are mixed in proportion to the square root of their sizes.
MIXING_POWER = 0.5


OP4_SQL = """
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weights AS (SELECT source, n, pow(n, 0.5) AS w FROM sizes),
means AS (SELECT source, w / (SELECT sum(w) FROM weights) * (SELECT count(*) FROM documents) / n AS mean FROM weights),
parted AS (SELECT source, greatest(ceil(mean / 16), 1) AS parts, mean / greatest(ceil(mean / 16), 1) AS mu FROM means),
poisson AS (
  SELECT source, mu, 0 AS k, exp(-mu) AS p, exp(-mu) AS c FROM parted
  UNION ALL SELECT source, mu, k + 1, p * mu / (k + 1), c + p * mu / (k + 1) FROM poisson WHERE k < 80
),
cuts AS (SELECT source, list(c ORDER BY k) AS cdf FROM poisson GROUP BY source),
uniforms AS (
  SELECT d.doc_id, d.source,
    ('0x' || substr(md5('42:' || d.doc_id || ':' || j.j), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents d JOIN parted USING (source), LATERAL (SELECT unnest(range(1, parts::BIGINT + 1)) AS j) j
),
copies AS (
  SELECT doc_id, sum(len(list_filter(cdf, lambda x: x <= u)))::BIGINT AS copies FROM uniforms JOIN cuts USING (source) GROUP BY doc_id
)
SELECT d.*, unnest(range(0, copies)) AS replicate FROM documents d JOIN copies USING (doc_id)
"""


@query("op4_mix_sources", OP4_SQL)
def op4_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    targets = tempered_weights(documents, MIXING_POWER, "source")
    mixed = replicate_haplotypes(documents, targets, population="source", haplotype_id="doc_id")
    return mixed.drop("shuffle_key").withColumn("replicate", F.col("replicate").cast("long"))


#: What messages of a conversation ask for: an answer to a question is expected, one to an instruction is not.
MESSAGE_SCHEMA = '{"additionalProperties":false,"properties":{"content":{"type":"string"}},"required":["content"],"type":"object"}'


OP5_SQL = """
WITH calls AS (SELECT * FROM conversations WHERE role <> 'assistant'),
answers AS (SELECT conv_id, turn - 1 AS turn, text AS result FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position,
  CASE WHEN result IS NULL AND role = 'user' THEN 'unanswered' ELSE 'linked' END AS status,
  '{"after":' || CASE WHEN turn > 0 THEN '[' || (turn - 2) || ',' || (turn - 1) || ']' ELSE '[]' END
  || ',"arguments":{"content":' || to_json(coalesce(text, ''))::VARCHAR || '},"id":' || turn || ',"name":' || to_json(role)::VARCHAR
  || ',"result":' || coalesce(to_json(result)::VARCHAR, 'null') || '}' AS line
FROM calls LEFT JOIN answers USING (conv_id, turn)
"""


@query("op5_link_calls", OP5_SQL)
def op5_link_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Messages that are not answers are calls named by their role; an answer's call is the message before it."""
    messages = spark.read.parquet(f"{folder}/conversations.parquet")
    answers = messages.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("request_id"), "turn", F.col("text").alias("result"))
    calls = messages.where("role is null or role != 'assistant'").select(
        "conv_id", F.col("turn").alias("request_id"), "turn", F.col("role").alias("statistic"),
        F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("content"))).alias("arguments"),
        F.when(F.col("turn") > 0, F.array(F.col("turn") - 1, F.col("turn") - 2)).otherwise(F.array().cast("array<long>")).alias("after"),
    )
    schemas = spark.createDataFrame([("user", MESSAGE_SCHEMA, True), ("system", MESSAGE_SCHEMA, False)], "statistic string, schema string, returns boolean")
    linked = link_requests(calls, answers, schemas, "conv_id")
    return linked.select("conv_id", F.col("request_id").alias("turn"), F.col("position").cast("long").alias("position"), "status", "line")


@query("op6_wavelet_shards")
def op6_wavelet_shards(spark: SparkSession, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    path = scratch_path(spark, "shards")
    ids_of = texts_as_ids(public_tokenizers.path("byte_bpe_50k.json"), end=2)
    write_packed_population(documents, path, "doc_id", "text", ids_of)
    rows = unpack_population(read_packed_population(spark, path), digest_only=True)
    return rows.toDF("doc_id", "start", "n_tokens", "ids_crc32")


@query("op7_simhash_near_duplicates")
def op7_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_logs(documents_as_logs(spark, folder)).withColumnRenamed("run_id", "doc_id")


@query("op8_main_text")
def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{folder}/pages.parquet")).toDF("page_id", "url", "text", "n_chars")


@query("op9_decontamination")
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return with_quotations(documents, benchmark, "doc_id", "text", "item_id", "text").withColumnRenamed("scenarios", "item_ids")


OP10_SQL = r"""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
),
words AS (SELECT doc_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM split),
windows AS (
  SELECT doc_id, p, n, md5(string_agg(word, ' ') OVER (
    PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS h FROM words
),
repeated AS (
  SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY h) AS times FROM windows WHERE p <= n - 34) WHERE times > 1
),
covered AS (SELECT DISTINCT doc_id, p + unnest(range(0, 35)) AS p FROM repeated),
kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS text
  FROM words ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""


@query("op10_repeated_passages", OP10_SQL)
def op10_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    kept = remove_repeated_passages(documents_as_logs(spark, folder))
    return kept.select(F.col("run_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    models = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = align_log_tokens(documents_as_logs(spark, folder), *models, digest_only=True)
    return aligned.withColumnsRenamed({"run_id": "doc_id", "groups": "groups_sha256"})


@query("op12_minhash_fingerprints")
def op12_minhash_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    compared = edited_log_likeness(documents_as_logs(spark, folder)).withColumn("edited", F.sha2("edited", 256))
    return compared.withColumnsRenamed({"run_id": "doc_id", "edited": "edited_sha256"})


@query("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(log_words(documents_as_logs(spark, folder), slips=199))
