"""The operators of this subpackage as queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .decontamination import contaminated
from .divergence import divergence
from .language_id import learn, predict
from .licenses import license_spans
from .line_dedup import without_repeats
from .main_text import extract
from .packing import pack
from .repeats import digest as repeats_digest
from .repeats import remove_repeats
from .secrets import digest, scan
from .simhash import near_groups
from .sketches import compare_with_next
from .token_counts import token_counts
from .twins import CONTAMINATED, DIVERGENCE, VECTOR_CODES, WITHOUT_REPEATS
from .vector_codes import compress
from .vector_codes import digest as vector_digest

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(key: str, sql: str | None = None):
    def register(run: Run) -> Run:
        QUERIES[key] = Query(run, sql)
        return run
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_token_counts")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"),
                        public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_best_fit_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_document_fingerprints")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return compare_with_next(table(spark, folder, "documents"))


@query("op9_simhash_near_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(table(spark, folder, "documents"))


@query("op2_benchmark_decontamination", CONTAMINATED)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_secret_scans")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return digest(scan(table(spark, folder, "documents")))


@query("op10_language_id")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return predict(docs, learn(docs))


@query("op4_line_dedup", WITHOUT_REPEATS)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return without_repeats(docs, counts=True, exact_chars=1)


@query("op8_license_scans")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return license_spans(table(spark, folder, "documents"))


@query("op6_suffix_array_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return repeats_digest(remove_repeats(table(spark, folder, "documents"), hashed=True))


@query("op11_source_divergence", DIVERGENCE)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return divergence(table(spark, folder, "documents"))


@query("op12_html_extraction")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))


@query("op13_vector_codes", VECTOR_CODES)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return vector_digest(*compress(table(spark, folder, "embeddings")))
