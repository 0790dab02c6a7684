"""Tables of a data folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.schemas import PARAMETERS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def parameter_rows(vectors: DataFrame, param_id: str, row: str, values: str) -> DataFrame:
    """A matrix's vectors as rows of the table of parameters, numbered as its column ``row``."""
    return vectors.select(F.lit(param_id).alias("param_id"), F.col(row).cast("long").alias("row_idx"), F.col(values).cast("array<float>").alias("values"))


def write_parameters(parameters: DataFrame, path: str) -> None:
    """(param_id, row_idx, values) as Parquet, a folder for each parameter, so that a scan of one reads no other."""
    parameters.select("param_id", "row_idx", "values").write.partitionBy("param_id").parquet(path)


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARAMETERS).parquet(path).select("param_id", "row_idx", "values")


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; where a local session names none, a temporary folder, once a context."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    known = context._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
        known = context._jsc.sc().getCheckpointDir()
    return known.get()


def run_folder(spark: SparkSession) -> str:
    """This application's folder in the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/gridloom-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below this application's folder in the shared folder."""
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> bool:
    """Delete a folder and all within it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> bool:
    """Delete all that this application wrote there; to be called once no result is read any more."""
    return delete(spark, run_folder(spark))


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
