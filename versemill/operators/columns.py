"""Projections, filters and scalar columns of the song table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.sources.songs import SONG_COLUMNS

# First and last year of the corpus.
FIRST_YEAR, LAST_YEAR = 1960, 2024


def select_song_columns(df: DataFrame) -> DataFrame:
    """Keep the nine song columns."""
    return df.select(*SONG_COLUMNS)


def year_in_range(
    low: int = FIRST_YEAR, high: int = LAST_YEAR, include_low: bool = False, include_high: bool = True
) -> Column:
    """Predicate: the year lies between two bounds."""
    year = F.col("year")
    above = year >= low if include_low else year > low
    return above & (year <= high if include_high else year < high)


def filter_year_range(df: DataFrame, *args: int, **kwargs: bool) -> DataFrame:
    """Keep a year range; see :func:`year_in_range`."""
    return df.where(year_in_range(*args, **kwargs))


def filter_year_window(df: DataFrame, first: int, last: int) -> DataFrame:
    """Keep the years from ``first`` to ``last``, both included."""
    return df.where(F.col("year").between(first, last))


def filter_genre(df: DataFrame, keep: str | None = None, drop: str | None = None) -> DataFrame:
    """Keep one genre and / or drop one; rows without a genre are dropped either way."""
    if keep is not None:
        df = df.where(F.col("tag") == keep)
    if drop is not None:
        df = df.where(F.col("tag") != drop)
    return df


def filter_language(df: DataFrame, language: str = "en") -> DataFrame:
    """Keep one language."""
    return df.where(F.col("language") == language)


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in the given columns, or in any column."""
    return df.dropna(subset=list(subset) if subset else None)


def drop_artist_prefix(df: DataFrame, prefix: str = "Genius") -> DataFrame:
    """Drop artists whose name starts with ``prefix``, and rows without an artist."""
    return df.where(~F.col("artist").startswith(prefix))


def filter_year_language(df: DataFrame, year: int, language: str = "en") -> DataFrame:
    """Keep one year and language."""
    return df.where((F.col("year") == year) & (F.col("language") == language))


def filter_decades(df: DataFrame, decades: Sequence[int], only: int | None = None) -> DataFrame:
    """Keep the listed decades, or one of them."""
    if only is None:
        return df.where(F.col("decade").isin(*decades))
    if only not in decades:
        raise ValueError(f"{only} is not among the decades {list(decades)}")
    return df.where(F.col("decade") == only)


def filter_artist(df: DataFrame, artist: str, before_year: int = 215) -> DataFrame:
    """Songs of one artist among those with an implausible year."""
    return df.where((F.col("year") < before_year) & (F.col("artist") == artist))


def filter_genre_decade(df: DataFrame, genre: str, decade: int | str) -> DataFrame:
    """Lyrics of one genre and decade."""
    return df.where((F.col("tag") == genre) & (F.col("decade") == int(decade))).select("id", "lyrics")


def rename_columns(df: DataFrame) -> DataFrame:
    """Name the genre and artist columns."""
    return df.withColumnsRenamed({"tag": "genre", "artist": "artist_name"})


def cast_views(df: DataFrame) -> DataFrame:
    """Views as integer; text that is no number becomes null."""
    return df.withColumn("views", F.col("views").try_cast("int"))


def decade_of(year: Column) -> Column:
    """First year of the decade."""
    return (F.floor(year / 10) * 10).cast("int")


def add_decade(df: DataFrame) -> DataFrame:
    """Append the decade."""
    return df.withColumn("decade", decade_of(F.col("year")))


def repair_two_digit_year(year: Column, strict: bool = True) -> Column:
    """Expand years written with two digits.

    101 to 2023 stay, 0 to 23 fall into the 2000s, 24 to 99 into the 1900s. Anything else
    is an error in strict mode and null otherwise.
    """
    otherwise = (
        F.raise_error(F.concat(F.lit("year out of range: "), year.cast("string"))).cast("int")
        if strict
        else F.lit(None).cast("int")
    )
    return (
        F.when((year > 100) & (year <= 2023), year.cast("int"))
        .when(year.between(0, 23), (year + 2000).cast("int"))
        .when(year.between(24, 99), (year + 1900).cast("int"))
        .when(year.isNotNull(), otherwise)
    )


def strip_dollar(artist: Column) -> Column:
    """Remove literal dollar signs."""
    return F.replace(artist, F.lit("$"), F.lit(""))


def clean_features(features: Column) -> Column:
    """Text such as ``{"A","B;C"}`` as an array; ``{}`` gives one empty string."""
    inner = F.regexp_replace(F.regexp_replace(features, r"^\{", ""), r"\}$", "")
    return F.split(F.replace(inner, F.lit('"'), F.lit("")), ",")


def replace_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Overwrite a column, keeping the old value where the new one is null."""
    return df.withColumn(name, F.coalesce(value, F.col(name)))
