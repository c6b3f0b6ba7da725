"""A corpus from raw documents to token ids, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.  doc_id identifies a document: rows that
repeat one share every decision.  Each stage works on all rows its predecessor
kept, and between stages rows are written as Parquet and read again, so a lost
executor costs one stage's tasks at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm.common import checkpoint_dir, table
from spandrel.llm.exact_dedup import exact_dedup
from spandrel.llm.mixing import mix
from spandrel.llm.pieces import encode
from spandrel.llm.quality import keep_quality, train
from spandrel.llm.queries import PIECE_FILE, quality_weights, tokenizer_path
from spandrel.llm.similar import similar_documents
from spandrel.session import removed


def _only(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id, null included, is in chosen (doc_id)."""
    ids = chosen.select(F.col("doc_id").alias("_kept"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_kept"]), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_quality(docs, train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id."""
    return _only(docs, exact_dedup(docs).where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose shingles of five words have a similarity of 0.8
    or more, by their fingerprints, the document with the smallest id."""
    return _only(docs, similar_documents(docs).where("doc_id <=> component_id"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    taken = mix(docs, weights=quality_weights(table(spark, sf_dir, "labels")))
    copies = taken.groupBy(F.col("doc_id").alias("id")).agg(F.max("copies").alias("n")).where("n > 0")
    # whole rows travel in one struct, so no column of docs can clash
    rows = docs.select(F.struct("*").alias("row")).join(copies, F.col("row.doc_id").eqNullSafe(F.col("id")))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, pieces, n_pieces, round_trip) of every row of the mix."""
    return encode(docs, tokenizer_path(PIECE_FILE))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("pieces", pieces)]

#: The stages' models and fingerprints have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents; rows between stages are kept in the
    shared checkpoint folder, and deleted when the next stage's are written."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            removed(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
