"""The ledger as a stream: an incremental projection of works, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "cursor long, event_id string, event_type string, entity_id string, title string, digest string, recorded_at timestamp"


def read_ledger(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of the ledger as they are appended."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def project_works(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append works that the ledger creates to ``target``, the first event of each; ends when the input is read.

    A batch is deduplicated in itself and against what is there. Spark gives a
    repeated batch the same number, so each batch overwrites its own folder and
    a restart leaves no row twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        made = batch.where("event_type = 'EntityCreated' and not startswith(entity_id, 'PTCND_')")
        first = made.groupBy(F.col("entity_id").alias("id")).agg(F.min_by("title", "cursor").alias("preferred_title"), F.min("cursor").alias("first_cursor"))
        try:
            old = spark.read.schema("id string, preferred_title string, first_cursor long, batch long").parquet(target).where(F.col("batch") < number)
            first = first.join(old.select("id"), "id", "left_anti")
        except Exception as missing:  # the first batch finds no folder
            if "PATH_NOT_FOUND" not in str(missing):
                raise
        first.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_per_window(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type in tumbling windows; events later than ``late`` behind the newest are dropped."""
    return events.withWatermark("recorded_at", late).groupBy(F.window("recorded_at", width), "event_type").agg(F.count("*").alias("n")).select("window.start", "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of an entity's events with no longer gap than ``gap``."""
    return events.withWatermark("recorded_at", late).groupBy(F.session_window("recorded_at", gap), "entity_id").agg(F.count("*").alias("n")).select("session_window.start", "session_window.end", "entity_id", "n")


def without_repeats(events: DataFrame, late: str = "2 hours") -> DataFrame:
    return events.withWatermark("recorded_at", late).dropDuplicatesWithinWatermark(["event_id"])
