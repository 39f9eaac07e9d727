"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of `documents`, with n_chars counted anew where a text changes. A stage's result is written as
Parquet and read again, so it is computed once and a lost executor costs no earlier stage; it is deleted once
the next stage's is whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import discard, written
from loomline.llm.line_dedup import dedup_lines
from loomline.llm.near_copies import near_copies as near_components
from loomline.llm.packing import pack
from loomline.llm.pii import redact
from loomline.llm.quality import classify

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being good is one half at least."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels).where(F.col("score") >= 0.5).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of repeated three-line windows; one of which nothing is left goes."""
    cleaned = dedup_lines(docs)
    left = cleaned.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each component of texts whose runs of five words have a Jaccard similarity of 0.8 or more.

    Of several texts with one id each is a document of its own. Rows equal in id and text are one document and stay or go together; rows without an id stay.
    """
    dropped = near_components(docs.select("doc_id", "text")).where(~F.col("kept")).select("doc_id", "mark")
    return docs.withColumn("mark", F.xxhash64("text")).join(dropped, ["doc_id", "mark"], "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and their characters counted anew. Null texts and their counts stay; rows that repeat stay."""
    cleaned = redact(docs.select(*COLUMNS))
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their token ids. Null and empty texts are the end token; rows that repeat are packed each; an empty table gives no pieces."""
    return pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_copies), ("PII", personal_data), ("packing", packing)]
# A trained classifier, a trained field and the curve can't be put in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; columns other than those of documents are dropped by the first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir))
        if before:
            discard(spark, before)
        before = path
    return docs
