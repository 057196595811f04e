"""Joins of many rows with a lookup table, safe for large lookups and hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.staging import stage

# A lookup is broadcast only below both bounds.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024

# Bound for lookups held by Python workers, where an entry takes its bytes and 16 more, or 36
# for a pair: with BROADCAST_BYTES at most 210 MB a worker.
PYTHON_ROWS = 4_000_000

# Rows of a key that one task may take. A key with more is hot and spread over as many
# parts as it needs; hot keys are fewer than the rows divided by this number.
TASK_ROWS = 2_000_000


def _width(name: str, kind: str) -> Column:
    """Bytes of a column's values, as far as they vary."""
    if kind in ("string", "binary"):
        size = F.octet_length(name)
    elif kind == "vector":
        size = 8 * F.size(vector_to_array(name)) + 16
    elif kind.startswith("array") and kind[6:-1] in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        size = 8 * F.size(name) + 16
    elif kind.startswith(("array", "map", "struct")):
        size = F.octet_length(F.to_json(F.struct(name)))
    else:
        size = F.lit(16)
    return F.coalesce(size, F.lit(0)).cast("long")


def fits_in_memory(lookup: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a table and tell whether every executor may hold it."""
    width = F.lit(0)
    for name, kind in lookup.dtypes:
        width = width + _width(name, kind)
    rows, size = lookup.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def join_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    max_rows: int | None = None,
    staged: bool = False,
) -> DataFrame:
    """Join ``rows`` with ``lookup`` (one row per key) on ``keys``.

    The lookup is staged and measured. A small one is broadcast, so ``rows`` is not
    shuffled. A large one is joined by shuffle: ``rows`` is staged, the rows of keys with
    more than ``TASK_ROWS`` are spread over enough parts by a hash of ``spread_by``, and
    only the matching lookup rows are repeated. Rows with a null key match nothing and are
    spread likewise.
    """
    keys = list(keys)
    lookup = lookup if staged else stage(lookup, "lookup")
    if fits_in_memory(lookup, BROADCAST_ROWS if max_rows is None else max_rows):
        return rows.join(F.broadcast(lookup), keys, how)

    rows = stage(rows, "lookup-rows")
    parts = F.ceil(F.count("*") / F.lit(TASK_ROWS)).cast("int")
    # at most rows / TASK_ROWS keys by construction
    hot = stage(rows.groupBy(*keys).agg(parts.alias("_parts")).where("_parts > 1"), "hot-keys")
    spread = F.xxhash64(*spread_by)
    absent = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    salted_rows = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt",
        F.when(absent, spread).otherwise(F.pmod(spread, F.coalesce("_parts", F.lit(1)))),
    )
    salted_lookup = lookup.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - F.lit(1).cast("long")))
    )
    return (
        salted_rows.drop("_parts")
        .join(salted_lookup.drop("_parts"), [*keys, "_salt"], how)
        .drop("_salt")
    )
