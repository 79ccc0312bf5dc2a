"""Structured Streaming ingest: tagged files that arrive in a folder become lines and running feature counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..sources.store import Store


def line_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(path, tag, body) of tagged lines as files arrive."""
    raw = spark.readStream.text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    return raw.filter(X.is_tagged(F.col("line"))).select("path", X.tag_of(F.col("line")).alias("tag"), X.untagged(F.col("line")).alias("body"))


def feature_stream(lines: DataFrame) -> DataFrame:
    """Running occurrences of each form."""
    return lines.select(F.explode(X.words(F.col("body"))).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


def into(store: Store, table: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends each micro-batch to a table once: a replayed batch is known by its number."""
    def sink(df: DataFrame, batch: int) -> None:
        if store.exists(table) and not store.read(table).filter(F.col("batch") == batch).isEmpty():
            return
        store.insert(table, df.withColumn("batch", F.lit(batch).cast("long")), check=False)

    return sink


def start(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """sink(batch, batch_id) once for each micro-batch; replays carry the same batch_id."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
