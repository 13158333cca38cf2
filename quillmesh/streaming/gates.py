"""The stateless stages on Structured Streaming, with accepted rows and rejects as two sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillmesh.operators.gates import reject_log, run_gates


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as they come; a single file is read through its folder."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.getFileStatus(at).isFile():
        return stream.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return stream.parquet(path)


def gate_stream(stream: DataFrame, key: str, text: str, registry: Sequence[tuple[str, Sequence[str]]], out: str, checkpoint: str, **options) -> StreamingQuery:
    """Runs all gates over a stream; each batch writes ``out``/accepted and ``out``/rejected once.

    A batch that is run again after a failure writes the same rows to the same
    place, as both paths hold its number.
    """
    gated = run_gates(stream, text, registry, **options)

    def sink(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        kept.filter("accepted").select(*stream.columns).write.mode("overwrite").parquet(f"{out}/accepted/batch={number}")
        reject_log(kept, key, text).write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")
        kept.unpersist()

    return gated.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_stream(events: DataFrame, time: str, by: Sequence[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by tumbling window and key; rows later than the watermark are left out."""
    windowed = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"))
    return windowed.select(F.col("w.start").alias("start"), *by, "n")


def run_to_end(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Drains what a stream holds now into ``sink``."""
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
