"""A corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. A stage works on all that its predecessor kept.

Defined results, in every stage: a null text counts as empty; other columns, of whatever name, come
through as they were; an empty table gives an empty table. Decisions are by row and not by doc_id, so
null and repeated ids lose no text and keep no copy; each stage's own cases are in its docstring.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, exact_dedup, jaccard, mixing, toxicity
from gridloom.llm.common import batch_rows, load, marked, written
from gridloom.llm.queries import BYTE_VOCABULARY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model of the labelled rows among docs does not reject.

    Rows without words score as no word at all and stay; equal texts are judged alike; rows with a null
    doc_id are judged and never teach; without labels of both classes every row stays.
    """
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    with batch_rows(spark, 512):
        return written(toxicity.clean(docs, model), "pipeline-clean")


def _one_of_each(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame], first: Column) -> DataFrame:
    """docs with one row of each group, the least by (first, row), whatever ids are null or repeated.

    grouped turns rows (doc_id, text), whose doc_id is a number of the row and never null or repeated,
    into (doc_id, group_id). Rows are numbered once and written, so every read finds the same numbers.
    """
    row = "row"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    found = grouped(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("numbered"), "group_id")
    ranks = rows.select(F.col(row).alias("member"), first.alias("first"))
    members = written(found.join(ranks, F.col("numbered") == F.col("member")).select("member", "group_id", "first"), "pipeline-groups")
    # One number for each group, combined on the map side: no task holds a group.
    stays = members.groupBy("group_id").agg(F.min(F.struct("first", "member")).alias("least")).select(F.col("least.member").alias("stays"))
    gone = written(members.join(stays, F.col("member") == F.col("stays"), "left_anti").select(F.col("member").alias("gone")), "pipeline-gone")
    # Only rows that a bitmap takes for gone are shuffled to what is gone; columns travel packed, whatever their names.
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(row).alias("member"), F.xxhash64(row).alias("hash"))
    flagged = marked(packed, gone.select(F.xxhash64("gone").alias("hash")), "maybe")
    checked = flagged.where("maybe").join(gone, F.col("member") == F.col("gone"), "left_anti")
    return flagged.where("not maybe").select("whole.*").union(checked.select("whole.*"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, of the largest doc_id; a null doc_id stays only where no row has another.

    Texts are equal after lower-casing A-Z; null and empty texts are one group. Among rows of the same
    largest id, and among repeated rows, one stays; rows of one id with different texts are told apart.
    """
    grouped = lambda rows: exact_dedup.dedup(rows).where("group_size > 1").withColumnRenamed("keep_id", "group_id")
    return _one_of_each(docs, grouped, F.struct(F.col("doc_id").isNull(), -F.col("doc_id").cast("decimal(20,0)")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked rows one, of the smallest doc_id; a null doc_id stays only where no row has another.

    Links are at a similarity of 0.75 of five-word shingles, followed through; rows without words are
    linked with nothing and all stay; of repeated rows one stays.
    """
    grouped = lambda rows: jaccard.join(rows).withColumnRenamed("component_id", "group_id")
    return _one_of_each(docs, grouped, F.struct(F.col("doc_id").isNull(), F.col("doc_id").cast("long")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the target weights.

    A null source or language is a value of its own; rows of cells without tokens stay; rows that
    repeat a doc_id are drawn alike, and null ids like the id -1.
    """
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: a row for each row, null ids stay null, empty texts have no ids."""
    return bpe.digests(docs, public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_jaccard", drop_near_copies), ("mixing", mix), ("byte_bpe", encode)]
#: Trained models and byte-pair merges are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
