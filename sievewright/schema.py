"""Row types of the tables that sources read and sinks write."""

from __future__ import annotations

from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("pii_replacements", T.MapType(T.StringType(), T.LongType())),
        T.StructField("quality_score", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
QUALITY_EXAMPLE = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType())])
SCALING_RUN = T.StructType([T.StructField(c, T.DoubleType()) for c in ("compute_budget", "parameters", "final_loss")])
REVIEW_LABEL = T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "text_preview", "human_label")])
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("tier", T.IntegerType())])
MERGE = T.StructType([T.StructField(c, T.IntegerType()) for c in ("rank", "left", "right")])
