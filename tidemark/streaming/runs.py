"""Starting streams, ending them, and reading what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table as a file stream, with the schema of the table.

    A file source takes a single file only through a pattern; the pattern matches a folder of
    that name as well.
    """
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def start(writer: DataStreamWriter, trigger: dict | None = None) -> StreamingQuery | None:
    """Starts a stream. Without a trigger it takes what is there and is waited for; with one, such as
    ``{"processingTime": "1 minute"}``, it goes on until it is stopped and is returned. The session's
    settings at the start rule its number of state stores."""
    running = writer.trigger(**(trigger or {"availableNow": True})).start()
    if trigger is not None:
        return running
    running.awaitTermination()
    return None


def append_available(
    stream: DataFrame, out: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery | None:
    """Runs over what is there and stops. The parquet sink commits each micro-batch once, so a
    restart from the checkpoint adds nothing twice."""
    writer = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
    )
    return start(writer, trigger)


def update_available(
    stream: DataFrame, out: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery | None:
    """Like ``append_available`` for changed rows. A micro-batch overwrites its own folder, so
    running it again after a failure changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    return start(writer, trigger)


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The last row written for each key."""
    written = spark.read.parquet(out)
    rest = [name for name in written.columns if name not in (*keys, "batch")]
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("row"))
    return last.select(*keys, "row.*")
