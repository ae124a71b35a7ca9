"""Registered queries of this package and the SQL that some of them must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm.common import table
from tracewell.llm.conversations import repair_conversations
from tracewell.llm.decontaminate import matches
from tracewell.llm.language import identify
from tracewell.llm.line_quality import quality
from tracewell.llm.neighbours import search_embeddings
from tracewell.llm.pieces import piece_digest
from tracewell.llm.secrets import scan
from tracewell.llm.simhash import near_duplicates
from tracewell.llm.spelling import spelling_variants
from tracewell.llm.suffix_dedup import remove_repeats
from tracewell.llm.surrogates import pseudonymise
from tracewell.llm.token_counts import token_counts
from tracewell.llm.url_filters import filter_urls
from tracewell.llm.url_query import ORACLE, captures, entries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, symbol and repetition counts and the verdict on every document."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: fixed patterns and the Markov ratio."""
    return scan(table(spark, sf_dir, "documents"))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by nearest centroids, learned from two folds of three."""
    return identify(table(spark, sf_dir, "documents"))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings of all documents removed."""
    return remove_repeats(table(spark, sf_dir, "documents"))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, huge ones by overlapping chunks."""
    return token_counts(table(spark, sf_dir, "documents"))


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, encoded and decoded."""
    return piece_digest(table(spark, sf_dir, "documents"))


@query
def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents within their edit budget."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in place of personal data."""
    return pseudonymise(table(spark, sf_dir, "documents")).select("doc_id", "n_entities", "text")


@query
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list entries active when it was fetched."""
    pages = table(spark, sf_dir, "pages")
    return filter_urls(captures(pages), entries(pages))


@query
def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th vector by inner product."""
    return search_embeddings(table(spark, sf_dir, "embeddings"))


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every damaged conversation."""
    return repair_conversations(table(spark, sf_dir, "conversations"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of all documents with their commoner spelling one edit away."""
    return spelling_variants(table(spark, sf_dir, "documents"))


ORACLES["op10_url_filters"] = ORACLE
