"""Song tables: schema, readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


# The columns of the raw song table.
SONG_COLUMNS = ("id", "title", "artist", "year", "tag", "language", "views", "features", "lyrics")

SONG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("artist", T.StringType()),
        T.StructField("year", T.LongType()),
        T.StructField("tag", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("views", T.StringType()),
        T.StructField("features", T.StringType()),
        T.StructField("lyrics", T.StringType()),
    ]
)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Read a Parquet table."""
    return spark.read.parquet(path)


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """Read a Parquet table; one with fewer splits than cores is spread over all cores."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_parquet(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write a Parquet table."""
    df.write.mode(mode).parquet(path)


def read_songs_csv(spark: SparkSession, path: str, schema: T.StructType = SONG_SCHEMA) -> DataFrame:
    """Read songs from CSV with a header and quoted multi-line text.

    Empty fields are null. A multi-line file is read by one task, so large inputs should be
    many files, and be converted to Parquet once.
    """
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', nullValue="")


def write_songs_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write CSV files with a header; text with quotes or line breaks is quoted."""
    df.write.mode(mode).csv(
        path,
        header=True,
        quote='"',
        escape='"',
        nullValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on the file system it belongs to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below a path, on the file system it belongs to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
    return [status.getPath().getName() for status in found if status.isDirectory()]


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished write left its success marker in ``path``."""
    return path_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


__all__ = [
    "SONG_COLUMNS",
    "SONG_SCHEMA",
    "folder_names",
    "is_complete",
    "path_exists",
    "read_parquet",
    "read_songs_csv",
    "read_spread",
    "write_parquet",
    "write_songs_csv",
]
