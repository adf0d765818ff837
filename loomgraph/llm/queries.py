"""The pN_ queries of the text problems, over whole tables and whole texts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.contamination import leaked_items
from loomgraph.llm.handwritten import not_handwritten
from loomgraph.llm.secrets import find_credentials, redact
from loomgraph.llm.subjects import composition, document_subjects
from loomgraph.llm.syntax.check import error_rates, parse_errors
from loomgraph.llm.tokenize import encode_corpus
from loomgraph.session import table

TOKENIZERS = os.environ.get("LOOMGRAPH_TOKENIZERS", "/opt/tokenizers")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that do not parse."""
    return parse_errors(table(spark, sf_dir, "documents"), key="doc_id", path="path", text="text").select("doc_id")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of files that do not parse, per repository and language."""
    files = table(spark, sf_dir, "documents")
    where = {"key": "doc_id", "path": "path", "text": "text"}
    return error_rates(files, parse_errors(files, **where), **where, by=["source", "lang"])


def _machine_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_handwritten(table(spark, sf_dir, "documents"), key="doc_id", path="path", owner="source", text="text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that were not written by hand."""
    return _machine_made(spark, sf_dir).select("doc_id")


def p5_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that were not written by hand, counted by reason."""
    return _machine_made(spark, sf_dir).groupBy("reason").agg(F.count(F.lit(1)).alias("n_files"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that may hold credentials: documents, and the snippets of findings, of which repeats count once."""
    documents = table(spark, sf_dir, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").cast("string").alias("rec_id"), F.col("source").alias("owner"), "text")
    findings = table(spark, sf_dir, "findings").select(F.lit("findings").alias("src"), F.col("id").alias("rec_id"), F.col("repo").alias("owner"), F.col("snippet").alias("text")).distinct()
    return documents.union(findings)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on which a credential starts."""
    return find_credentials(_texts(spark, sf_dir)).select("src", "rec_id", F.when(F.col("src") == "findings", 1).otherwise(F.col("line_no")).alias("line_no")).distinct()


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold credentials, with these masked."""
    documents = _texts(spark, sf_dir).filter("src = 'documents'")
    return redact(documents, find_credentials(_texts(spark, sf_dir)).filter("src = 'documents'")).select(F.col("rec_id").cast("bigint").alias("doc_id"), "text")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, sf_dir, "documents"), key="doc_id", text="text", vocabulary=f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"), doc_key="doc_id", doc_text="text", item_key="item_id", item_text="text", min_words=13)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 13 consecutive words of a held-out item."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items with the documents that hold them and the greatest coverage."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("longest").alias("longest"), F.max(F.col("covered") / F.col("item_words")).alias("coverage"))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_samples"), table(spark, sf_dir, "subject_areas"), key="doc_id", text="text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one or two subjects of each document."""
    return _subjects(spark, sf_dir).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composition of the corpus by subject."""
    return composition(_subjects(spark, sf_dir))


QUERIES = {"p4_found": p4_found, "p4_rates": p4_rates, "p5_found": p5_found, "p5_reasons": p5_reasons, "p6_found": p6_found, "p6_redacted": p6_redacted, "p8_ids": p8_ids, "p9_found": p9_found, "p9_items": p9_items, "p10_found": p10_found, "p10_composition": p10_composition}
_LEAKS = """
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM heldout_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(ws[n:n + 12], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS n FROM d)),
ig AS (SELECT item_id, array_to_string(ws[n:n + 12], ' ') AS gram FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 11)) AS n FROM i))
"""
ORACLES: dict[str, str] = {"p9_found": _LEAKS + "SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (gram)"}
