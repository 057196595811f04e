"""Numbered batches of consecutive rows, stored as one Parquet partition each.

Only the order column is sorted. The row that begins a batch gives a boundary, and every
other row finds its batch by a binary search over the boundaries, so that rows with their
texts are neither sorted nor shuffled to be numbered.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versemill.joins import fits_in_memory
from versemill.sources.songs import folder_names, is_complete
from versemill.staging import stage, with_row_index

CHUNK_SIZE = 10**6

# More files than this many per task and batch, and rows are moved together before a write.
_FILES = 3


def batch_starts(df: DataFrame, chunksize: int = CHUNK_SIZE, order: str = "id") -> DataFrame:
    """``(batch_id, key, first)``, written: the value of ``order`` that begins each batch.

    ``first`` is the place of the first row with that value; nulls come before all values.
    One row per batch. This is the only step that sorts, and it reads nothing but ``order``.
    """
    ranked = with_row_index(df.select(F.col(order).alias("key")), F.asc_nulls_first("key"), name="place")
    starts = stage(ranked.where(F.col("place") % chunksize == 0), "batch-starts")
    keys = starts.select(F.col("key").alias("_key")).distinct()
    keys = F.broadcast(keys) if fits_in_memory(keys) else keys
    firsts = (
        ranked.join(keys, F.col("key").eqNullSafe(F.col("_key")), "left_semi")
        .groupBy(F.col("key").alias("_key"))
        .agg(F.min("place").alias("first"))
    )
    found = starts.join(firsts, F.col("key").eqNullSafe(F.col("_key")))
    batch = (F.col("place") / chunksize).cast("int") + 1
    return stage(found.select(batch.alias("batch_id"), "key", "first"), "batch-bounds")


def _not_above(keys: Column, value: Column, count: int) -> Column:
    """How many of ``count`` sorted keys are not above ``value``, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, count.bit_length())))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= count) & (F.get(keys, at + step - 1) <= value), at + step
        ).otherwise(at),
    )


def split_batches(df: DataFrame, chunksize: int = CHUNK_SIZE, order: str = "id") -> DataFrame:
    """Number consecutive rows into batches of ``chunksize``; the last one may be short.

    Rows are ordered by ``order``, nulls first. Where rows that share a value lie on both
    sides of a boundary, these rows alone are sorted, by their place in the input.
    """
    starts = batch_starts(df, chunksize, order)
    absent, count = starts.agg(F.count_if(F.col("key").isNull()), F.count("key")).first()
    # one value per batch: the boundaries are a constant of the plan
    keys = starts.agg(F.array_sort(F.collect_list("key"))).scalar()

    def by_search(rows: DataFrame) -> DataFrame:
        after = absent + _not_above(F.col("_starts"), F.col(order), count)
        batch = F.when(F.col(order).isNull(), 1).otherwise(after).cast("int")
        return rows.withColumn("_starts", keys).withColumn("batch_id", batch).drop("_starts")

    shared = starts.where((F.col("batch_id") - 1) * F.lit(chunksize) != F.col("first"))
    shared = stage(shared.select(F.col("key").alias("_key"), "first").distinct(), "batch-ties")
    if not shared.head(1):
        return by_search(df)

    lookup = F.broadcast(shared) if fits_in_memory(shared) else shared
    same = F.col(order).eqNullSafe(F.col("_key"))
    alone = by_search(df.join(lookup, same, "left_anti"))
    tied = df.join(lookup, same).withColumn("_place", F.monotonically_increasing_id())
    tied = with_row_index(tied, F.asc_nulls_first(order), "_place", name="_index")
    begins = tied.groupBy(F.col("_key").alias("_tied")).agg(F.min("_index").alias("_begin"))
    begins = F.broadcast(begins) if fits_in_memory(begins) else begins
    place = F.col("first") + F.col("_index") - F.col("_begin")
    tied = tied.join(begins, F.col("_key").eqNullSafe(F.col("_tied"))).withColumn(
        "batch_id", (F.floor(place / chunksize) + 1).cast("int")
    )
    return alone.unionByName(tied.select(*alone.columns))


def write_batches(df: DataFrame, path: str, chunksize: int = CHUNK_SIZE, order: str = "id") -> None:
    """Write the batches, one partition per batch.

    Input that is nearly in order, as a file read in chunks is, is written where it lies.
    Only if its tasks would leave many files per batch, which the order column alone tells,
    rows are first brought together by batch.
    """
    batches = split_batches(df, chunksize, order)
    spread = batches.select("batch_id", F.spark_partition_id().alias("part"))
    files, tasks, count = spread.agg(
        F.count_distinct("batch_id", "part"), F.count_distinct("part"), F.count_distinct("batch_id")
    ).first()
    if files > _FILES * (tasks + count):
        batches = batches.repartition("batch_id")
    batches.write.partitionBy("batch_id").parquet(path)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches with their ``batch_id``."""
    return spark.read.parquet(path)


def batch_ids(spark: SparkSession, path: str) -> list[int]:
    """The batch numbers that exist, from the names of the folders; no file is opened."""
    names = folder_names(spark, path)
    return sorted(int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id="))


def _read_folders(spark: SparkSession, path: str, chosen: list[int]) -> DataFrame:
    folders = [f"{path.rstrip('/')}/batch_id={i}" for i in chosen]
    return spark.read.option("basePath", path).parquet(*folders)


def load_batch(
    spark: SparkSession,
    path: str,
    batch_id: int,
    source: DataFrame | None = None,
    chunksize: int = CHUNK_SIZE,
) -> DataFrame:
    """One batch, read from its folder alone. With ``source`` given, missing batches are built on first use."""
    if source is not None and not is_complete(spark, path):
        write_batches(source, path, chunksize)
    if batch_id not in batch_ids(spark, path):
        raise ValueError(f"batch {batch_id} does not exist in {path}")
    return _read_folders(spark, path, [batch_id])


def random_batches(spark: SparkSession, path: str, n_batches: int = 3, seed: int = 42) -> DataFrame:
    """A seeded draw of distinct batches, concatenated."""
    available = batch_ids(spark, path)
    if n_batches > len(available):
        raise ValueError(f"asked for {n_batches} batches, only {len(available)} exist")
    chosen = random.Random(seed).sample(available, n_batches)
    return _read_folders(spark, path, chosen)


def union_batches(*batches: DataFrame) -> DataFrame:
    """Concatenate batches by column name, keeping duplicates."""
    first, *others = batches
    for other in others:
        first = first.unionByName(other)
    return first
