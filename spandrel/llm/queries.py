"""Queries of the text problems by name, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm.docpairs import documented_functions
from spandrel.llm.encode import encode_corpus
from spandrel.llm.handwritten import not_handwritten
from spandrel.llm.leaks import leaked
from spandrel.llm.subjects import main_subjects
from spandrel.llm.syntax import error_rates, unparsable
from spandrel.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return not_handwritten(table(spark, d, "files"), table(spark, d, "entities"), table(spark, d, "upstream_files")).select("path")


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    """path, why: the reason a file counts as not written by hand."""
    return not_handwritten(table(spark, d, "files"), table(spark, d, "entities"), table(spark, d, "upstream_files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return unparsable(table(spark, d, "files")).select("path")


def p4_errors(spark: SparkSession, d: str) -> DataFrame:
    """path, repo, language, cost, lines, why of every file that does not parse."""
    return unparsable(table(spark, d, "files"))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return error_rates(table(spark, d, "files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return documented_functions(table(spark, d, "files"), table(spark, d, "entities")).select("path", "name")


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """path, name, kind, doc: functions with their documentation."""
    return documented_functions(table(spark, d, "files"), table(spark, d, "entities"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p7_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents and tokens by source."""
    docs = table(spark, d, "documents")
    n = encode_corpus(docs).select("doc_id", F.size("ids").alias("n"))
    return n.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked(table(spark, d, "documents"), table(spark, d, "instances"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """instance_id, docs: the items that leaked, with the number of documents."""
    return p8_found(spark, d).groupBy("instance_id").agg(F.count("*").alias("docs"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return main_subjects(table(spark, d, "documents"), table(spark, d, "subjects"), table(spark, d, "labels")).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """subject, docs: documents by main subject."""
    return p9_found(spark, d).groupBy("subject").agg(F.count("*").alias("docs"))


QUERIES = {f.__name__: f for f in (p3_found, p3_reasons, p4_found, p4_errors, p4_rates, p6_found, p6_pairs, p7_ids, p7_token_counts, p8_found, p8_items, p9_found, p9_composition)}
ORACLE: dict[str, str] = {}
