"""The two batch jobs: songs and featured artists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versemill.joins import join_lookup
from versemill.operators import artists, columns
from versemill.sources.songs import read_parquet, write_parquet
from versemill.staging import scope, stage


def prefilter_steps() -> dict[str, Column]:
    """The row filters of the song job, in order, for :func:`step_counts`."""
    return {
        "input": F.lit(True),
        "year": columns.year_in_range(),
        "genre": F.col("tag") != "misc",
        "lyrics": F.col("lyrics").isNotNull() & F.col("tag").isNotNull(),
    }


def prefilter(df: DataFrame) -> DataFrame:
    """Song columns of rows with a plausible year, a genre and lyrics."""
    df = columns.select_song_columns(df)
    df = columns.filter_year_range(df)
    df = columns.filter_genre(df, drop="misc")
    return columns.drop_nulls(df, ["lyrics", "tag"])


def songs_etl(df: DataFrame, min_songs: int = artists.MIN_SONGS) -> DataFrame:
    """Raw songs to the trusted song table."""
    df = columns.cast_views(columns.rename_columns(prefilter(df)))
    df = artists.add_artist_id(columns.add_decade(df))
    df = artists.keep_prolific_artists(df, min_songs)
    return df.withColumn("features", columns.clean_features(F.col("features")))


def artists_etl(songs: DataFrame, with_features: bool = True) -> DataFrame:
    """The trusted song table to one row per artist and featured artist.

    Without ``with_features`` the array of all features of the artist is left out, and no
    row carries one.
    """
    sets = stage(artists.artist_feature_sets(songs), "feature-sets")
    rows = artists.feature_display_name(artists.explode_features(sets))
    rows = join_lookup(rows, artists.feature_counts(sets), ["artist_id"], spread_by=["feature_name"])
    columns_out = ["artist_id", "artist_name", "num_songs", "num_features", "feature_name"]
    if with_features:
        whole = artists.artist_features(sets).select("artist_id", "features")
        rows = join_lookup(rows, whole, ["artist_id"], spread_by=["feature_name"])
        columns_out.insert(3, "features")
    return rows.select(*columns_out)


def run_etl(spark: SparkSession, raw: str, songs_out: str, artists_out: str, min_songs: int = artists.MIN_SONGS) -> None:
    """Read raw songs, write both tables; the second job reads what the first one wrote."""
    with scope():
        write_parquet(songs_etl(read_parquet(spark, raw), min_songs), songs_out, mode="overwrite")
        write_parquet(artists_etl(read_parquet(spark, songs_out)), artists_out, mode="overwrite")
