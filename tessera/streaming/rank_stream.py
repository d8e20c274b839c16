"""A stream of queries ranked against a static corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def rank_stream(queries: DataFrame, ranker: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Starts a query that ranks each micro-batch of queries (query_id, text) and writes Parquet under path, a folder for each batch.

    Ranking needs row_number over non-time windows, which a streaming DataFrame doesn't allow; each batch is therefore an
    ordinary job. A batch that is run again overwrites its own folder, so results come exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        ranker(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def query_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema("query_id string, text string").json(path)
