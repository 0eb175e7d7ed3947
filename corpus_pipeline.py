"""The corpus pipeline: documents through the stages of STAGES, in order.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs; all but the last return the columns of documents.

Defined cases, for all stages: null and empty texts, null ids and null labels pass every stage; repeated rows
count as rows, but for near-dedup, which keeps one row of an id; extra columns of whatever name
go; an empty table stays empty; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.llm import line_dedup as lines
from rowsmith.llm import mixing, packing, toxicity
from rowsmith.llm._store import Store
from rowsmith.llm.near_dedup import deduplicate
from rowsmith.llm.queries import TOKENIZER

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Expected tokens against those a domain has: good text slightly more than once, poor text seldom.
GOOD, POOR = 1.05, 0.25


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field predicts toxic go."""
    return toxicity.drop_toxic(docs.select(*COLUMNS), toxicity.train(docs, _labels(spark, sf_dir)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of 50 words or more go; a document of which nothing is left goes too."""
    fixed = lines.line_dedup(docs.select(*COLUMNS)).where("n_lines_removed = 0 or btrim(text) <> ''")
    return fixed.withColumn("n_chars", F.when(F.col("n_lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near-duplicates stays."""
    return deduplicate(docs.select(*COLUMNS), k=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the rates of their soft domains say: good ones once or twice, poor ones seldom."""
    docs = docs.select(*COLUMNS)
    labelled = mixing.domains_of(docs, _labels(spark, sf_dir))
    mixed = mixing.mix(docs, labelled, factors=lambda d: GOOD if d.endswith("/good") else POOR if d.endswith("/poor") else 1.0)
    return mixing.apply_copies(docs, mixed)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER), 4096, 2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", source_mix),
    ("packing", pack),
]

#: Tokenizer, random field and sketches are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is written and read again."""
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
