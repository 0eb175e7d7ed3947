"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.llm import hamming, html_text, mixing, quality, toxicity, warc
from rowsmith.llm.near_dedup import near_duplicates
from rowsmith.llm.packing import pack
from rowsmith.llm.passage_dedup import passage_dedup
from rowsmith.llm.simhash import edit_study
from rowsmith.llm.toxicity import held_out

TOKENIZER = "word_bpe_49k.json"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later copies of runs of 50 words or more."""
    return passage_dedup(_docs(spark, sf_dir)).select("doc_id", "text", "n_lines_removed")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    import public_tokenizers

    return pack(_docs(spark, sf_dir), public_tokenizers.path(TOKENIZER), 4096, 2).drop("ids")


#: Shares of all tokens that the mix shall have, by domain.
MIX = {"en/good": 0.40, "de/good": 0.20, "fr/good": 0.20, "es/good": 0.15, "en/poor": 0.02, "de/poor": 0.01, "fr/poor": 0.01, "es/poor": 0.01}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of every document, so that expected token totals are in the shares of MIX."""
    docs = _docs(spark, sf_dir)
    labelled = mixing.domains_of(docs, _labels(spark, sf_dir))
    return mixing.mix(docs, labelled, weights=MIX).select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), "posterior", "rate", "copies")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share four fifths of their 4-word shingles."""
    return near_duplicates(_docs(spark, sf_dir), k=4, percent=80)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edits, and their neighbours within 3 bits."""
    return edit_study(_docs(spark, sf_dir), radius=3)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = _docs(spark, sf_dir)
    scored = quality.quality(docs, _labels(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.main_text(_pages(spark, sf_dir))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest codes, among all rows, of every row whose id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), hamming.code(F.col("embedding")).alias("code"))
    return hamming.top_k(rows, rows.where("id % 50 = 0"), k=10)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc.round_trip(_pages(spark, sf_dir), least=0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score and offending spans of every document."""
    docs = _docs(spark, sf_dir)
    scored = toxicity.toxicity(docs, toxicity.train(docs, _labels(spark, sf_dir)))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", "spans")


#: Brute force: every query against every row.
OP8_SQL = """
WITH codes AS (
  SELECT vec_id AS id,
         list_sum([CASE WHEN embedding[i + 1] > 0 THEN (1::HUGEINT << i) ELSE 0::HUGEINT END FOR i IN range(64)]) AS code
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
), pairs AS (
  SELECT q.id AS query_id, r.id AS id, bit_count(xor(q.code::UBIGINT, r.code::UBIGINT))::INTEGER AS distance
  FROM codes q CROSS JOIN codes r WHERE q.id % 50 = 0
), ranked AS (
  SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank FROM pairs
)
SELECT query_id, id, distance, rank FROM ranked WHERE rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_packing, op3_mixing, op4_minhash_near_dedup, op5_quality_classifier, op6_simhash, op7_html_extraction, op8_exact_top_k, op9_warc, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_top_k": OP8_SQL}
