"""A graph kept up to date by a stream of file deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.common import latest
from skein.sources.scan import extract

FILES = "file_id long, repo string, path string, size long, modified timestamp, code_lang string, content string, loaded_at timestamp"


def entity_stream(spark: SparkSession, folder: str, out: str, state: str):
    """A query that parses every file delivered to ``folder`` (Parquet) into ``out``.

    Each micro-batch is parsed on the executors and appended with its batch id; a batch that
    is run again after a failure replaces its own folder, so every delivery counts once.
    """
    files = spark.readStream.schema(FILES).parquet(folder)

    def batch(df: DataFrame, number: int) -> None:
        once = latest(df.filter("content is not null"), "file_id").select(F.concat_ws("/", "repo", "path").alias("path"), "content")
        extract(once).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True)


def late_counts(events: DataFrame, delay: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Deliveries by repository and hour of a stream of rows (repo, loaded_at), closed by a watermark."""
    return events.withWatermark("loaded_at", delay).groupBy("repo", F.window("loaded_at", size)).agg(F.count("*").alias("n"))
