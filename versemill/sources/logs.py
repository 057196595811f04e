"""Training logs of topic models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versemill.staging import with_row_index

# Fixed value: the part of a log line that reports the per-word bound and the perplexity.
METRICS_PATTERN = r"(-*\d+\.\d+) per-word .* (\d+\.\d+) perplexity"


def training_log_metrics(spark: SparkSession, path: str) -> DataFrame:
    """``(seq, bound, perplexity)`` of the matching lines, numbered in line order."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
        "value",
    )
    found = lines.where(F.col("value").rlike(METRICS_PATTERN)).select(
        "_file",
        "_block",
        "_line",
        F.regexp_extract("value", METRICS_PATTERN, 1).try_cast("double").alias("bound"),
        F.regexp_extract("value", METRICS_PATTERN, 2).try_cast("double").alias("perplexity"),
    )
    return with_row_index(found, "_file", "_block", "_line", name="seq", start=1).select(
        "seq", "bound", "perplexity"
    )


def last_metrics(metrics: DataFrame, n: int = 50) -> DataFrame:
    """The last ``n`` reported values, in line order."""
    return metrics.orderBy(F.desc("seq")).limit(n).orderBy("seq")
