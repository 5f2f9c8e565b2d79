"""Structured Streaming front end for the star loader.

New raw files in the staging folder are picked up by a file stream; each
micro-batch is cleaned and loaded with the same set-based loader as a batch
run.  Exactly-once: the stream's own checkpoint tracks which files were
consumed, and each batch's query and epoch ids are recorded in the warehouse commit log,
so an epoch replayed after a crash is skipped instead of loaded twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from plantpulse.operators.clean import convert
from plantpulse.schema import RAW, SOURCE_NOTES
from plantpulse.sources.warehouse import Warehouse


def start_incremental_load(spark: SparkSession, staging_path: str, wh: Warehouse,
                           checkpoint: str | None = None, available_now: bool = False,
                           max_files_per_trigger: int = 1000,
                           processing_time: str = "1 minute") -> StreamingQuery:
    """Start the stream.  ``available_now=True`` loads everything present and
    stops (a catch-up run); otherwise it polls on ``processing_time``.

    Every micro-batch is a load and adds a partition to each table, so the
    trigger's interval decides how large these are."""
    checkpoint = checkpoint or f"{wh.root}/_stream_checkpoint"
    stream = (spark.readStream.schema(T.StructType([*RAW.fields, *SOURCE_NOTES]))
              .option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(staging_path))

    def load_batch(batch: DataFrame, epoch_id: int) -> None:
        # the query's id lives in its checkpoint: another stream, or a reset one, has another id
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        wh.load(convert(batch), batch_key=f"stream:{query_id}:{epoch_id}")

    writer = stream.writeStream.foreachBatch(load_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start()
