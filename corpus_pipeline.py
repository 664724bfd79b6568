"""From raw documents to training sequences: five stages, each one corpus operator.

Every stage takes the whole table its predecessor kept and its decisions take effect: documents
without a learned language go, repeated lines leave the texts, one document of each near-duplicate
group stays (the smallest id), contaminated documents go, and the rest is packed. All stages but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandara.llm.arrow import fresh
from demandara.llm.decontamination import decontaminate
from demandara.llm.language_id import identified, learn, limits
from demandara.llm.line_dedup import without_repeats
from demandara.llm.packing import pack
from demandara.llm.queries import Query
from demandara.llm.simhash import one_of_each
from demandara.session import materialise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what has no learned language: texts without a letter, and texts further from their
    nearest profile than that language's own documents are."""
    profiles = learn(docs)
    return identified(docs, profiles, furthest=limits(docs, profiles))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts, exact repeats at any length; n_chars follows if there."""
    found, removed = without_repeats(docs, counts=True, exact_chars=1), fresh(docs, "n_removed")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(
            F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*(f"`{c}`" for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: three-word shingles, at most two differing bits."""
    return one_of_each(docs, words=3, radius=2)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates),
          ("benchmark_decontamination", benchmark), ("best_fit_packing", sequences)]

#: Fingerprints, rank-order profiles and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs


QUERY = Query(run, ORACLE_SQL)
