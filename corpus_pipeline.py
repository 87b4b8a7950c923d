"""A corpus pipeline over documents: each stage applies one training-data operator to what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm.common import cut, table
from tarnwick.llm.jaccard_dedup import keep_one_similar
from tarnwick.llm.mixing import mix
from tarnwick.llm.packing import pack_documents
from tarnwick.llm.quality_classifier import keep_good
from tarnwick.llm.queries import WORD_TOKENIZER
from tarnwick.llm.secret_scan import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null and empty texts are judged like others, an empty table stays empty, extra columns come back as they are."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: those linked by five-word shingles with a Jaccard similarity of 0.8 or more.

    SimHash links come first, each confirmed by the sets of shingles; prefix filtering finds the links that SimHash's radius misses.
    """
    return keep_one_similar(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and n_chars follows the text; null texts and their n_chars, and extra columns, stay as they are."""
    return redact(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with all its columns; an empty table stays empty."""
    taken = mix(docs, docs.columns).where("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences; copies of a document are packed like any others. Workers remember fewer words than by themselves, as executors are full by now."""
    return pack_documents(docs, public_tokenizers.path(WORD_TOKENIZER), remembered=300_000)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", packing),
]

#: The classifier, XXH64 and the tokenizer are beyond SQL: tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each one's rows written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
