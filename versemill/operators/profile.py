"""Profiling: sizes, types, nulls, distinct values, step counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _unpivot(row: DataFrame, names: Sequence[str], label: str, value: str) -> DataFrame:
    """Turn a one-row frame of counts into ``(label, value)`` rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias(label), F.col(f"`{n}`").cast("long").alias(value)) for n in names])
    return row.select(F.inline(pairs))


def head_rows(df: DataFrame, n: int = 5, order: str = "id") -> DataFrame:
    """The first ``n`` rows in an explicit order."""
    return df.orderBy(order).limit(n)


def column_profile(df: DataFrame, exact: bool = False, rsd: float = 0.02) -> DataFrame:
    """``(column, type, nulls, distinct_values)`` for every column.

    The default is one pass with a fixed-size sketch per column. ``exact`` counts distinct
    128-bit digests, so long texts are not shuffled.
    """
    types = dict(df.dtypes)
    kind = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])[F.col("column")].alias("type")
    if not exact:
        sketches = [F.count_if(F.col(c).isNull()).alias(f"n:{c}") for c in df.columns]
        sketches += [F.approx_count_distinct(c, rsd).alias(f"d:{c}") for c in df.columns]
        per_column = F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.col(f"`n:{c}`").alias("nulls"),
                    F.col(f"`d:{c}`").alias("distinct_values"),
                )
                for c in df.columns
            ]
        )
        return df.agg(*sketches).select(F.inline(per_column)).select("column", kind, "nulls", "distinct_values")
    cells = df.select(
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("column"), F.md5(F.col(c).cast("string")).alias("digest")) for c in df.columns])
        )
    )
    return (
        cells.groupBy("column", "digest")
        .agg(F.count("*").alias("n"))
        .groupBy("column")
        .agg(
            F.coalesce(F.sum(F.when(F.col("digest").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
            F.count("digest").alias("distinct_values"),
        )
        .select("column", kind, "nulls", "distinct_values")
    )


def frame_size(df: DataFrame, key: str = "id") -> DataFrame:
    """``(n_rows, n_cells, distinct_ids)``; a null key counts as one value."""
    return df.agg(
        F.count("*").alias("n_rows"),
        (F.count("*") * len(df.columns)).alias("n_cells"),
        (F.countDistinct(key) + F.max(F.col(key).isNull().cast("long"))).alias("distinct_ids"),
    )


def batch_row_counts(batches: DataFrame) -> DataFrame:
    """Rows per batch, labelled ``data 1``, ``data 2``, …"""
    return batches.groupBy("batch_id").count().select(
        F.concat(F.lit("data "), F.col("batch_id")).alias("batch"), F.col("count").alias("n_rows")
    )


def null_columns(df: DataFrame) -> DataFrame:
    """``(column, nulls)`` of the columns that hold a null."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return _unpivot(counts, df.columns, "column", "nulls").where("nulls > 0")


def rows_with_nulls(df: DataFrame) -> DataFrame:
    """Rows with a null in any column."""
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in df.columns]))


def distinct_years(df: DataFrame) -> DataFrame:
    """The distinct years."""
    return df.select("year").distinct()


def step_counts(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """``(step, n_rows)``: rows left after each step, all from one pass.

    Each step is a predicate; a row passes a step if it passed the ones before as well.
    """
    passed, counts = F.lit(True), []
    for name, predicate in steps.items():
        passed = passed & predicate
        counts.append(F.count_if(passed).alias(name))
    return _unpivot(df.agg(*counts), list(steps), "step", "n_rows")
