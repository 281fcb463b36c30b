"""A training corpus from `documents`, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of `documents` and drop any further ones; `n_chars` follows the text
where a stage changes it. Null and empty texts are scored like texts without
words, and stay null or empty if they are kept (the last stage gives them the
empty text and no ids); rows without an id are kept by the near-duplicate
stage; repeated rows lose all but one there; very long texts are worked on
whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import table, written
from siltstone.llm.decontam import decontaminated
from siltstone.llm.neardup import near_duplicates
from siltstone.llm.quality import CUT, fit_ranking, quality_scores
from siltstone.llm.queries import held_out, vocabulary
from siltstone.llm.sentencepiece import encoded
from siltstone.llm.substrings import without_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return df.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts (operator 3)."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return quality_scores(docs.select(*COLUMNS), fit_ranking(docs, labels)).where(F.col("quality_score") >= CUT).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (operator 10), the one with the smallest id.

    Five-word shingles, similarity 0.8. A row that repeats another goes too; rows without an id stay.
    """
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    stays = docs.select(*COLUMNS).join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")
    return stays.withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"]).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 35 words that repeat anywhere (operator 6)."""
    return _documents(without_repeats(docs.select(*COLUMNS)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of the benchmark (operator 1)."""
    return _documents(decontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the text that they decode to (operator 8)."""
    model = vocabulary("piece_bpe_32k.model")
    coded = encoded(docs.select(*COLUMNS), model, decoded_col="decoded")
    return coded.select("doc_id", F.col("decoded").alias("text"), "lang", "source", "n_chars", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Ranking, components and shortest paths can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
