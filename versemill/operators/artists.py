"""Artists: ids, song counts and featured artists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.joins import join_lookup

# Fixed value: songs an artist needs to be kept.
MIN_SONGS = 15


def generate_uuid(df: DataFrame, name: str = "uuid") -> DataFrame:
    """Append a random unique id."""
    return df.withColumn(name, F.uuid())


def add_artist_id(df: DataFrame) -> DataFrame:
    """Append an id that depends on the artist name only; rows without a name are dropped."""
    return df.where(F.col("artist_name").isNotNull()).withColumn("artist_id", F.md5("artist_name"))


def artists_dim(df: DataFrame) -> DataFrame:
    """``(artist_id, artist_name)``, one row per artist."""
    return add_artist_id(df.select("artist_name")).select("artist_id", "artist_name").distinct()


def songs_per_artist(df: DataFrame) -> DataFrame:
    """``(artist_id, artist_name, num_songs)``."""
    return df.groupBy("artist_id", "artist_name").agg(F.count("*").alias("num_songs"))


def keep_prolific_artists(df: DataFrame, min_songs: int = MIN_SONGS, key: str = "id") -> DataFrame:
    """Keep artists with at least ``min_songs`` songs and append ``num_songs``."""
    prolific = songs_per_artist(df).where(F.col("num_songs") >= min_songs)
    return join_lookup(df, prolific, ["artist_id", "artist_name"], spread_by=[key])


def drop_empty_features(df: DataFrame) -> DataFrame:
    """Keep rows whose feature array is present and free of empty strings."""
    return df.where(~F.array_contains("features", ""))


def artist_feature_sets(df: DataFrame) -> DataFrame:
    """Distinct feature arrays of each artist.

    Duplicates go before any grouping by artist, with partial aggregation, so an artist
    with very many songs costs only as much as their distinct arrays. Joining the arrays
    back to the songs of the same artist would only repeat them, hence there is no join.
    """
    return (
        drop_empty_features(df)
        .select("artist_id", "artist_name", "num_songs", "features")
        .distinct()
    )


def artist_features(df: DataFrame) -> DataFrame:
    """Per artist the elements of their distinct feature arrays, and how many.

    The result holds one array per artist by definition. Nothing else here builds it:
    :func:`explode_features` and :func:`feature_counts` work on the distinct arrays.
    """
    return (
        artist_feature_sets(df)
        .groupBy("artist_id", "artist_name", "num_songs")
        .agg(F.flatten(F.array_sort(F.collect_list("features"))).alias("features"))
        .withColumn("num_features", F.size("features"))
    )


def feature_counts(sets: DataFrame) -> DataFrame:
    """``(artist_id, num_features)`` of distinct feature arrays; sums are combined before the shuffle."""
    return sets.groupBy("artist_id").agg(F.sum(F.size("features")).cast("int").alias("num_features"))


def explode_features(df: DataFrame) -> DataFrame:
    """One row per artist and feature, without the arrays; empty arrays give no row.

    ``df`` holds the distinct arrays of :func:`artist_feature_sets`, so no array of a whole
    artist is ever built, or those of :func:`artist_features`; the rows are the same.
    """
    return df.select(*(c for c in df.columns if c != "features"), F.explode("features").alias("feature_name"))


def feature_display_name(df: DataFrame) -> DataFrame:
    """Write ``a;b`` as ``a b``."""
    return df.withColumn("feature_name", F.replace("feature_name", F.lit(";"), F.lit(" ")))
