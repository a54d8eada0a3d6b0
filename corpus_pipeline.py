"""The corpus pipeline: documents in, sampled token ids of the clean documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written before the next one reads it. All stages but
the last return the columns of ``documents``; null ids are kept, for no rule names them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm import decontaminate, jaccard_join, pii, piece_lattice, quality
from harrow.llm._shared import keep, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table keeps."""
    return quality.judge(docs, into="__quality").where("__quality.kept").drop("__quality")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their shingles, directly or through others, the one with the smallest id."""
    return jaccard_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage. Rows are told apart by id and text, so that neither null nor repeated ids matter."""
    keyed = docs.withColumn("__row_key", F.xxhash64("doc_id", "text"))
    leaked = decontaminate.leaks(keyed, table(spark, sf_dir, "benchmark"), key="__row_key").select("__row_key").distinct()
    return keyed.join(leaked, "__row_key", "left_anti").select(*docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind in brackets; ``n_chars`` follows the text."""
    found = pii.find(docs.withColumnsRenamed({"base": "__base", "spans": "__spans"}))
    clean = found.withColumn("text", F.explode(F.array(pii.redact(F.col("text"), F.col("spans")))))
    return clean.withColumn("n_chars", F.length("text").cast("long")).drop("base", "spans").withColumnsRenamed({"__base": "base", "__spans": "spans"}).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled SentencePiece ids of each document, and the text that they decode to."""
    path = piece_lattice.default_model()
    coded = piece_lattice.with_pieces(docs, path, back="decoded")
    return coded.select("doc_id", "lang", "source", F.col("decoded").alias("text"), F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("PII", redacted),
    ("SentencePiece encoding and decoding", token_ids),
]

#: Sampled segmentations and trained trees can't be told in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs, "stage")
    return docs
