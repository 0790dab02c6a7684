"""What the operators of this subpackage share: the shared folder, written tables, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.tables import clean, delete, new_folder, run_folder, shared_root  # noqa: F401  shared with the first part


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for what runs within; after it the setting is as before."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder, at a fresh path or at this one, and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or new_folder(spark, label)
    # Spark keeps the text of every plan that ran; literals and long lineages make long texts.
    with setting(spark, "spark.sql.maxPlanStringLength", "10000"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def batch_rows(spark: SparkSession, rows: int):
    """Bounds the rows of Arrow batches in jobs that run within."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Bits of a bitmap for each value, its most bits (it goes to every task), and bits of one of its pieces.
BITS_A_VALUE, MOST_BITS, PIECE = 16, 1 << 27, 1 << 15


def marked(rows: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """rows with a boolean column ``name``: false only where the long column ``hash`` is surely not among values (hash).

    A Bloom filter of one hash function: values set bits of a bitmap of bounded size, which is
    broadcast in pieces. Beyond the bound more rows are true that need not be.
    """
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(PIECE.bit_length() - 1, (BITS_A_VALUE * values.count()).bit_length()))
    spot = F.pmod(F.col("hash"), F.lit(bits))
    spots = values.select(spot.alias("spot")).distinct()
    # At most bits / PIECE rows of PIECE bits: MOST_BITS / 8 bytes.
    pieces = spots.groupBy(F.floor(F.col("spot") / PIECE).alias("piece")).agg(F.bitmap_construct_agg(F.col("spot") % PIECE).alias("bitmap"))
    octet = F.conv(F.hex(F.substring("bitmap", (F.floor(F.col("spot") % PIECE / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    out = rows.withColumn("spot", spot).withColumn("piece", F.floor(F.col("spot") / PIECE)).join(F.broadcast(pieces), "piece", "left")
    return out.withColumn(name, F.coalesce(F.getbit(octet, (F.col("spot") % 8).cast("int")) == 1, F.lit(False))).drop("piece", "spot", "bitmap")


def hand_back() -> None:
    """Hands memory that is no longer used back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def released(run):
    """A mapInArrow function that hands memory back when it ends: workers stay for later tasks of other operators."""

    @wraps(run)
    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        hand_back()

    return around


def sliced(batches: Iterator[pa.RecordBatch], column: str, rows: int = 512, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of batches of at most so many rows and, but for a longer single one, bytes of a text column."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, k = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), 0
        while k < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[k] + size, side="right")) - 1
            stop = max(k + 1, min(stop, k + rows))
            yield batch.slice(k, stop - k)
            k = stop


def batches_of(rows: int):
    """A decorator: batch_rows around a function of a DataFrame, for the jobs that it runs itself."""

    def around(f):
        @wraps(f)
        def run(df: DataFrame, *args, **named):
            with batch_rows(df.sparkSession, rows):
                return f(df, *args, **named)

        return run

    return around


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path for a URI or a plain path."""
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:") and not uri.startswith("file://"):
            uri = "file://" + uri[5:]
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def table_path(sf_dir: str, table: str) -> str:
    return f"{sf_dir.rstrip('/')}/{table}.parquet"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, table))


def text_of(column: str = "text") -> F.Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(column), F.lit(""))
