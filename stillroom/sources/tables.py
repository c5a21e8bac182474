"""Parquet tables, and the shared folder in which lineage is cut."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``, pruned to ``columns`` if any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def use_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the cluster names in spark.checkpoint.dir. Where that is unset, a temporary folder is used if Spark runs on this machine
    alone; on a cluster no other machine could read it, so there it is an error."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="stillroom-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession) -> str:
    """A new folder name beside the checkpoints, for files that are written and read again."""
    return f"{use_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back, so that later steps neither repeat nor re-partition it."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """``cut``, with the shuffled files that led to it removed: Spark keeps them until the driver happens to collect its garbage, and a query with several cuts would hold all of them at once."""
    spark, done = df.sparkSession, cut(df)
    del df  # a caller's name for it would keep its files
    release(spark)
    return done


def release(spark: SparkSession) -> None:
    """Removes shuffled files that no plan needs any more."""
    gc.collect()
    spark._jvm.System.gc()


def stored(df: DataFrame, *by: str) -> str:
    """A shared folder that holds the rows as Parquet files, those of each value of ``by`` in a subfolder of their own. It is removed when Spark ends; shuffled files that led to it, as in ``settled``."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    del df
    release(spark)
    return path


def kept(df: DataFrame) -> DataFrame:
    """``settled`` with the rows in Parquet files, which are smaller than a checkpoint's; they are removed when Spark ends."""
    return df.sparkSession.read.parquet(stored(df))
