"""Incremental ingest of pair rows: an addition to what batch queries offer, on Structured Streaming.

Counts per protein are kept in the state store and the watermark bounds what is remembered of repeated deliveries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.accession import accession
from ..operators.pairs import unordered


def pair_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def normalized(stream: DataFrame) -> DataFrame:
    lo, hi = unordered("a", "b")
    named = stream.select("*", accession(F.col("protein_a")).alias("a"), accession(F.col("protein_b")).alias("b")).filter("a is not null and b is not null and a <> b")
    return named.select(lo.alias("lo"), hi.alias("hi"), "label", F.col("ingested_at").cast("timestamp").alias("at"))


def first_deliveries(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """Each (pair, label) once; deliveries later than ``delay`` after the newest one are late and may come again."""
    return normalized(stream).withWatermark("at", delay).dropDuplicatesWithinWatermark(["lo", "hi", "label"])


def degree_updates(stream: DataFrame) -> DataFrame:
    """Running number of first-delivered positive pairs per protein (update mode)."""
    ends = stream.filter("label = 1").select(F.explode(F.array("lo", "hi")).alias("protein_id"))
    return ends.groupBy("protein_id").agg(F.count(F.lit(1)).alias("positive_degree"))


def monthly_counts(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """Rows per 30-day window of ingest, emitted when the watermark has passed it (append mode)."""
    rows = normalized(stream).withWatermark("at", delay)
    return rows.groupBy(F.window("at", "30 days").alias("w")).agg(F.count(F.lit(1)).alias("n_rows")).select(F.col("w.start").alias("start"), "n_rows")


def run_once(df: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; a second call goes on from the checkpoint."""
    if mode == "append":
        query = df.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        def save(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

        query = df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
