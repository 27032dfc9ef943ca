"""Reading input tables and cutting lineage in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.shared import fresh_path, session_dir, shared_dir


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxed(df: DataFrame, **more: Column) -> DataFrame:
    """df's columns in one struct, _doc, beside columns of ours, so that no name
    of theirs meets one of ours; select("_doc.*") takes them out again."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_doc"), *(c.alias(n) for n, c in more.items()))


def clean(spark: SparkSession) -> None:
    """Deletes the tables that this application has stored. Results that are not yet written are lost with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df reliably, so that later reads survive lost executors."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """As cut(), as a Parquet table: smaller on disk and prunable by column."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
