"""Counts, shares, rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.joins import join_lookup


def _counts(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def count_by_year(batches: DataFrame, first: int, last: int) -> DataFrame:
    """Songs per batch and year in a year window."""
    return _counts(batches.where(F.col("year").between(first, last)), "batch_id", "year")


def count_by_decade(df: DataFrame) -> DataFrame:
    """Songs per decade."""
    return _counts(df, "decade")


def count_by_decade_genre(df: DataFrame, decade: int | None = None) -> DataFrame:
    """Songs per decade and genre, or those of one decade."""
    return _counts(df if decade is None else df.where(F.col("decade") == decade), "decade", "tag")


def genre_share_by_decade(df: DataFrame) -> DataFrame:
    """Share of each genre within its decade."""
    counts = count_by_decade_genre(df)
    totals = counts.groupBy("decade").agg(F.sum("n").alias("total"))
    return counts.join(totals, "decade").select("decade", "tag", "n", (F.col("n") / F.col("total")).alias("share"))


def outlier_genre_counts(df: DataFrame, before_year: int = 215) -> DataFrame:
    """Genres of the songs with an implausible year."""
    return _counts(df.where(F.col("year") < before_year), "tag")


def count_by_genre(df: DataFrame) -> DataFrame:
    """Songs per genre."""
    return _counts(df, "tag")


def genre_views(df: DataFrame) -> DataFrame:
    """Songs and total views per genre."""
    return df.groupBy("tag").agg(F.count("*").alias("n"), F.sum("views").alias("total_views"))


def value_share(df: DataFrame, value: str | Column, name: str = "value", share: str = "percent") -> DataFrame:
    """Percentage of each value among the non-null values."""
    counts = (
        df.select((F.col(value) if isinstance(value, str) else value).alias(name))
        .where(F.col(name).isNotNull())
        .groupBy(name)
        .agg(F.count("*").alias("n"))
    )
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(name, "n", (F.col("n") / total * 100).alias(share))


def sample_representativeness(full: DataFrame, sample: DataFrame, value: str | Column) -> DataFrame:
    """Percentages of each value in the full set and the sample, and their difference."""
    in_full = value_share(full, value, share="total_percent").drop("n")
    in_sample = value_share(sample, value, share="sample_percent").drop("n")
    return (
        in_full.join(in_sample, "value", "full_outer")
        .fillna(0.0, ["total_percent", "sample_percent"])
        .withColumn("difference", F.col("sample_percent") - F.col("total_percent"))
    )


def group_count_per_row(df: DataFrame, group: str = "decade", key: str = "id", name: str = "group_count") -> DataFrame:
    """Repeat the size of its group on each row, without moving the rows by group."""
    counts = _counts(df.where(F.col(group).isNotNull()), group, name=name)
    return join_lookup(df, counts, [group], spread_by=[key], how="left")


def top_viewed(df: DataFrame, n: int = 20) -> DataFrame:
    """The most viewed rows; ties by id."""
    return df.orderBy(F.desc("views"), "id").limit(n)


def first_by_year(df: DataFrame, n: int = 20) -> DataFrame:
    """The rows with the earliest years; ties by id."""
    return df.orderBy("year", "id").limit(n)


def coherence_by_setting(results: DataFrame | None, setting: str = "alpha") -> DataFrame:
    """Mean coherence per number of topics, split by one model setting."""
    if results is None:
        raise ValueError("no grid results available")
    return results.groupBy(setting, "topics").agg(F.avg("coherence").alias("coherence"))


def select_best_model(results: DataFrame, tie_break: Sequence[str] = ("topics",)) -> DataFrame:
    """The first row with the highest coherence; what still ties goes by the other columns in turn."""
    others = [c for c in results.columns if c != "coherence" and c not in tie_break]
    return results.orderBy(F.desc("coherence"), *tie_break, *others).limit(1)
