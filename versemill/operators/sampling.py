"""Random, repeatable and balanced samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versemill.joins import join_lookup
from versemill.sources.songs import is_complete
from versemill.staging import stage

BUCKETS = 16**4


def sample_fraction(df: DataFrame, fraction: float = 0.05, seed: int = 42) -> DataFrame:
    """A random sample of about ``fraction`` of the rows."""
    return df.sample(fraction=fraction, seed=seed)


def sample_hash(key: str = "id", seed: int = 42) -> Column:
    """A uniform hexadecimal number per row that depends on key and seed only."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def sample_fraction_hash(df: DataFrame, fraction: float = 0.05, seed: int = 42, key: str = "id") -> DataFrame:
    """A sample that does not depend on how the rows are partitioned; a plain filter."""
    if fraction >= 1:
        return df
    bound = f"{int(fraction * 2**32):08x}"
    return df.where(F.substring(sample_hash(key, seed), 1, 8) < bound)


def sample_balanced(
    df: DataFrame, prop: float = 0.2, group: str = "decade", key: str = "id", seed: int = 20
) -> DataFrame:
    """The same number of rows, ``int(prop * smallest group)``, from every group.

    Each group keeps its rows with the smallest hashes. The limiting hash is found on keys
    alone: counts per group and hash prefix tell in which prefix the limit lies, and only
    the rows of that prefix, about one in 65,536, are ranked. The rows themselves are then
    merely filtered, so a group with a third of all rows needs no special care.
    """
    keyed = df.where(F.col(group).isNotNull()).select(group, sample_hash(key, seed).alias("_hash"))
    prefixes = stage(
        keyed.groupBy(group, F.substring("_hash", 1, 4).alias("_prefix")).agg(F.count("*").alias("_n")),
        "hash-prefixes",
    )
    smallest = prefixes.groupBy(group).agg(F.sum("_n").alias("_rows")).agg(F.min("_rows")).first()[0] or 0
    wanted = int(prop * smallest)
    # at most BUCKETS rows per group
    before = Window.partitionBy(group).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    last_prefix = (
        prefixes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .where((F.col("_before") < wanted) & (F.col("_before") + F.col("_n") >= wanted))
        .select(group, "_prefix", (F.lit(wanted) - F.col("_before")).alias("_take"))
    )
    edge = join_lookup(
        keyed.withColumn("_prefix", F.substring("_hash", 1, 4)), last_prefix, [group, "_prefix"], spread_by=["_hash"]
    )
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_hash"))
    limits = edge.withColumn("_rank", rank).where("_rank = _take").select(group, F.col("_hash").alias("_limit"))
    return (
        join_lookup(df, limits, [group], spread_by=[key]).where(sample_hash(key, seed) <= F.col("_limit")).drop("_limit")
    )


def group_frequency_weights(df: DataFrame, prop: float = 0.3, group: str = "decade", key: str = "id") -> DataFrame:
    """Weight ``prop * rows / (distinct group sizes * own group size)`` per row."""
    sizes = stage(
        df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("group_count")), "group-sizes"
    )
    rows = df.agg(F.count("*")).scalar()
    distinct_sizes = sizes.agg(F.countDistinct("group_count")).scalar()
    return join_lookup(df, sizes, [group], spread_by=[key], how="left", staged=True).withColumn(
        "freq", F.lit(prop) * rows / (distinct_sizes * F.col("group_count"))
    )


def load_or_create_sample(spark: SparkSession, path: str, create: Callable[[], DataFrame]) -> DataFrame:
    """Reuse the sample saved at ``path``; compute and save it if there is none."""
    if not is_complete(spark, path):
        create().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
