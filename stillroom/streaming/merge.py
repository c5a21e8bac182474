"""An extension: listings that arrive as a stream, merged into a state of the last row for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stillroom.operators.ingest import last_writes


def merge_stream(arrivals: DataFrame, target: str, key: list[str], order: str, progress: str) -> StreamingQuery:
    """Merges every micro-batch into the state under ``target``: a folder for each version, of which a batch writes the next one, so that a repeated batch
    writes the same version again. Runs until what has arrived is processed."""

    def merge(batch: DataFrame, epoch: int) -> None:
        version = f"{target}/v={epoch + 1}"
        before = batch.sparkSession.read.parquet(f"{target}/v={epoch}") if epoch else None
        rows = batch if before is None else before.unionByName(batch)
        last_writes(rows, key, [F.col(order)]).write.mode("overwrite").parquet(version)

    return arrivals.writeStream.foreachBatch(merge).option("checkpointLocation", progress).trigger(availableNow=True).start()


def current_state(spark: SparkSession, target: str) -> DataFrame:
    """The last version of a state, on any file system that Spark reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(target)
    names = [f.getPath().getName() for f in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]
    return spark.read.parquet(f"{target}/v={max(int(n.split('=')[1]) for n in names if n.startswith('v='))}")
