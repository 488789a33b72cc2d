"""A corpus from documents to token ids, as written stages. Each works on all that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import byte_bpe, chosen_path, decontamination, line_dedup, toxicity
from tracelake.llm.queries import RANKS, digests
from tracelake.llm.shared import fold, table, written

# Workers serve all stages, so what they remember of matches has to be small.
MATCHES_KEPT = 40_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that the classifier rejects. It learns from the labelled folds, as its query does."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return toxicity.score(docs, model, out="_toxicity").where("_toxicity < 0.5").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them hold; ``n_chars`` is that of the new text."""
    found = line_dedup.dedup_lines(docs, names=("_n_lines", "_n_dropped", "_kept_text"))
    changed = F.col("_n_dropped") > 0
    text = F.when(changed, F.col("_kept_text")).otherwise(F.col("text"))
    n_chars = F.when(changed, F.length("_kept_text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns({"text": text, "n_chars": n_chars}).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component, and one of rows that repeat an id and a text."""
    found = written(spark, chosen_path.near_duplicates(docs.select("doc_id", "text")), "near-duplicates")
    return chosen_path.one_row_of_each(docs, found)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that repeat a test item."""
    leaks = written(spark, decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark")), "leaks")
    return decontamination.without_leaks(docs, leaks, chosen_path.IDS_SENT)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their digest."""
    rows = docs.select("doc_id", "lang", "source", "text")
    tokens = digests(byte_bpe.encode(rows, RANKS, remembered=MATCHES_KEPT).drop("text"))
    return tokens.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "token_ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

# The classifier cannot be written in SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each gives is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return docs
