"""A training corpus from the documents table: the stages in order, each over all that the one before kept.

Ids may be null, repeated or of any type that has an order: rows are told apart by id and text together, and rows that
agree in both are copies, of which the second stage keeps one. An empty table stays empty; columns beyond those of
``documents`` are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraseg.llm import decontaminate, langid, mixing, ngram_join, pii
from paraseg.llm.common import written
from paraseg.llm.queries import MIX_POWERS, fold, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keyed(docs: DataFrame) -> DataFrame:
    """With ``key``: id and a hash of the text. A decision is for all rows that have both; the id may be null or repeated."""
    return docs.withColumn("key", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("text_hash")))


def joined(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` whose key is in ``keys`` (``left_semi``) or is not (``left_anti``)."""
    named = keys.select(F.col("key.doc_id").alias("key_id"), F.col("key.text_hash").alias("key_hash")).distinct()
    return docs.join(named, (F.xxhash64("text") == F.col("key_hash")) & F.col("doc_id").eqNullSafe(F.col("key_id")), how).select(COLUMNS)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts that are null, without letters or unlike any language go."""
    found = langid.identify(keyed(docs), fold(4) != 2, id_col="key")
    return joined(docs, found.filter("not rejected").select(F.col("doc_id").alias("key")), "left_semi")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of documents linked by five-word shingles at 0.8 or more.

    Null ids come last; of rows with the same id and text one stays; rows with the same id and other texts are documents
    of their own.
    """
    groups = ngram_join.jaccard_components(keyed(docs), id_col="key", words=5, percent=80)
    first = written(groups.filter("doc_id = component_id").groupBy(F.col("doc_id").alias("key")).count())
    again = joined(docs, first.filter("count > 1"), "left_semi").withColumn("text_hash", F.xxhash64("text"))
    return joined(docs, first.filter("count = 1"), "left_semi").union(again.dropDuplicates(["doc_id", "text_hash"]).select(COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.contaminated(keyed(docs), table(spark, sf_dir, "benchmark"), id_col="key")
    return joined(docs, found.select(F.col("doc_id").alias("key")), "left_anti")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each personal span of their texts replaced by its kind; lengths follow."""
    weights = pii.fit(written(pii.find(docs).select("candidates")))
    spans = pii.with_spans(pii.find(docs), weights)
    clean = spans.withColumn("text", pii.redacted(F.col("text"), F.col("spans")))
    changed = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics have their target weights, with the probability of each."""
    return mixing.mix(docs, MIX_POWERS, share=0.5).filter("sampled").select(*COLUMNS, "topic", "tokens", "weight", "probability")


STAGES = [
    ("language", known_language),
    ("near duplicates", one_of_each_group),
    ("benchmark", without_benchmark),
    ("personal data", without_personal_data),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs


#: Models are trained in the first, third and fourth stage: not a matter of SQL.
ORACLE_SQL = None
