"""Documents and metrics as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import text as tx

METRICS = "step bigint, split string, loss double, at timestamp"


def document_stream(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def first_seen(stream: DataFrame, text_col: str, time_col: str, delay: str = "7 days") -> DataFrame:
    """Rows whose text has not come within `delay`: state is a hash per text and ends with the watermark."""
    return stream.withColumn("_h", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["_h"]).drop("_h")


def delivery_counts(stream: DataFrame, time_col: str, source_col: str, window: str = "7 days", delay: str = "28 days") -> DataFrame:
    """Documents and characters by window and source; rows later than `delay` are left out."""
    return stream.withWatermark(time_col, delay).groupBy(F.window(time_col, window).alias("w"), source_col).agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters")).select(F.col("w.start").alias("window_start"), source_col, "documents", "characters")


def masked(stream: DataFrame, text_col: str) -> DataFrame:
    """Normalised and masked text with counts; stateless, so the same function as in batch."""
    return tx.with_masked(stream.withColumn(text_col, tx.normalize_text(F.col(text_col))), text_col, text_col).withColumn("pii_replacements", tx.pii_map()).drop(*tx.PII_KEYS)


def metric_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(METRICS).json(path)


def best_losses(stream: DataFrame) -> DataFrame:
    return stream.groupBy("split").agg(F.min("loss").alias("best_loss"), F.max("step").alias("last_step"))
