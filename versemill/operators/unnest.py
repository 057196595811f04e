"""One row per array element.

For the inner generators Catalyst adds a filter on the array's size and evaluates the array
again for it, which doubles the cost of cleaning and tokenising. The outer forms with an
explicit null test give the same rows and evaluate the array once. Elements must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, array: str | Column, name: str, *keep: str | Column) -> DataFrame:
    """``keep`` columns and one element each."""
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def unnest_with_position(df: DataFrame, array: str | Column, position: str, name: str, *keep: str | Column) -> DataFrame:
    """``keep`` columns, the element's position from 0, and the element."""
    return df.select(*keep, F.posexplode_outer(array).alias(position, name)).where(F.col(name).isNotNull())


def unnest_structs(df: DataFrame, array: Column, names: Sequence[str], *keep: str | Column) -> DataFrame:
    """``keep`` columns and the fields of one element each; the first field is never null."""
    return df.select(*keep, F.inline_outer(array).alias(*names)).where(F.col(names[0]).isNotNull())
