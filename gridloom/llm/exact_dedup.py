"""Exact deduplication by a stateful stream.

Documents land as rows (digest, second digest, stable identifier, content locator) in a folder that
a structured stream reads. The stream's state, kept on disk by RocksDB without expiry, retains for
each digest the identifier and locator (file and row) of the row that stays, the number of rows and
the second digests' common and united bits, which differ where two of them do. What stays and a group's size come from the state.

A digest that the state has seen more than once is a hit, and the full bytes of its rows are
compared: rows whose second digest falls on a bit of the hits' bitmap (a Bloom filter of one hash, at
most ``MOST_BITS`` bits) are read again and grouped on the text itself, combined on the map side, so
that texts without a hit are not shuffled, but for the filter's errors, and a hot group crosses the
shuffle once for each task. Where the bytes of a digest's rows agree, the row that the state's
locator names must be among them. Where they differ, the digest clashed and its groups are taken
from the bytes.

Texts are equal when identical after lower-casing A-Z; of equal texts the row of the largest doc_id
stays.

Defined results: a null text is empty; a null doc_id never stays where another id is in the group,
else keep_id is null and kept true; rows that repeat a doc_id get a row each, all kept if that id
stays; an empty table gives no rows; other columns are ignored. Two different texts that share both
digests stop the job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import marked, new_folder, text_of, written

LANDED = "doc_id long, digest binary, second long, file string, place long"
#: MB that RocksDB may use in an executor, over all its state stores.
STATE_MB = 64
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": str(STATE_MB),
    # Many small stores would else set megabytes aside for each log.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # Executors let go of a stream's stores at this interval after it has ended.
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def placed(docs: DataFrame) -> DataFrame | None:
    """(doc_id, text, file, place) of documents read from files; None where rows have no place in a file."""
    try:
        if "_metadata" in docs.columns:
            return None
        out = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
        return out if out.schema else None
    except AnalysisException:
        return None


class ExactDedup:
    """A dedup whose state lives in a folder; documents are added in any number of calls."""

    def __init__(self, spark: SparkSession, folder: str | None = None, digest: Callable[[Column], Column] = sha256):
        self.spark, self.digest = spark, digest
        self.folder = folder or new_folder(spark, "exact-dedup")
        self.landing, self.checkpoint = f"{self.folder}/landing", f"{self.folder}/state"
        self.contents: list[DataFrame] = []

    def add(self, docs: DataFrame) -> None:
        """Land the documents and fold them into the state; a failed call is repeated from the stream's checkpoint.

        Documents that are not read from files are written first: a locator names a file and a row.
        """
        rows = placed(docs)
        if rows is None:
            rows = placed(written(docs.select("doc_id", "text"), "dedup-content"))
        self.contents.append(rows)
        text = normal(text_of())
        keyed = rows.select(F.col("doc_id").cast("long").alias("doc_id"), self.digest(text).alias("digest"), F.xxhash64(text).alias("second"), "file", "place")
        keyed.write.mode("append").parquet(self.landing)
        before = {k: self.spark.conf.get(k, None) for k in _STATE}
        for k, v in _STATE.items():
            self.spark.conf.set(k, v)
        try:
            landed = self.spark.readStream.schema(LANDED).parquet(self.landing)
            state = landed.groupBy("digest").agg(
                F.max(F.struct("doc_id", "file", "place")).alias("stays"), F.count("*").alias("n"), F.bit_and("second").alias("low"), F.bit_or("second").alias("high")
            )
            query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def state(self) -> DataFrame:
        """(digest, doc_id, file, place, n, low, high): what the state retains."""
        held = self.spark.read.format("statestore").load(self.checkpoint)
        stays, n, low, high = (F.col(f"value.`{name}`") for name in held.schema["value"].dataType.names)
        return held.select("key.digest", stays["doc_id"].alias("doc_id"), stays["file"].alias("file"), stays["place"].alias("place"), n.alias("n"), low.alias("low"), high.alias("high"))

    def _suspects(self, landed: DataFrame, hits: DataFrame) -> DataFrame:
        """(doc_id, digest, second, text, file, place) of all rows with a hit's digest, and few others."""
        seconds = landed.join(hits.select("digest"), "digest", "left_semi").select(F.col("second").alias("hash"))
        text, some = normal(text_of()), None
        for content in self.contents:
            rows = content.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), "file", "place").withColumn("hash", F.xxhash64("text"))
            some = rows if some is None else some.unionByName(rows)
        some = marked(some, seconds, "hit").where("hit")
        return some.select("doc_id", self.digest(F.col("text")).alias("digest"), F.col("hash").alias("second"), "text", "file", "place")

    def resolve(self) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, digest) of every row that was added through this object."""
        hits = written(self.state().where("n > 1"), "dedup-hits")
        landed = self.spark.read.schema(LANDED).parquet(self.landing)
        by_bytes = self._suspects(landed, hits).groupBy("digest", "second", "text").agg(F.max(F.struct("doc_id", "file", "place")).alias("stays"), F.count("*").alias("n"))
        checked = by_bytes.groupBy("digest", "second").agg(
            F.max("stays").alias("own"), F.max("n").alias("own_n"),
            F.when(F.count("*") > 1, F.raise_error(F.lit("different texts share both digests"))).otherwise(F.lit(1)).alias("texts"),
        ).where("texts is not null")
        both = hits.join(checked, "digest")
        clash = F.col("low") != F.col("high")
        agree = F.col("own").eqNullSafe(F.struct("doc_id", "file", "place")) & (F.col("own_n") == F.col("n"))
        wrong = F.raise_error(F.lit("the bytes at a locator are not those of its digest"))
        groups = both.select(
            "digest", "second", F.when(clash, F.col("own.doc_id")).when(agree, F.col("doc_id")).otherwise(wrong).alias("stays_id"), F.when(clash, F.col("own_n")).otherwise(F.col("n")).alias("n")
        )
        found = landed.select("doc_id", "digest", "second").join(groups, ["digest", "second"], "left")
        keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("stays_id"))
        return found.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "digest")


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs (doc_id, text)."""
    run = ExactDedup(docs.sparkSession)
    run.add(docs)
    return run.resolve().select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
