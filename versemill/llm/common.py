"""Helpers shared by the training-data operators.

Operators take an id column and a text column and read nothing else of a frame, so other
columns, whatever their names, pass by untouched. A null text counts as empty. Ids need not
be unique or present: where rows must be told apart, a written table numbers them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from versemill.joins import fits_in_memory
from versemill.staging import stage

# Texts in one step of a Python worker: its arrays stay near this many bytes times a small
# factor, unless one text alone is longer.
STEP_BYTES = 1_000_000

# Bytes of one batch between the JVM and a Python worker. Spark's bound of 64 MB, doubled by
# growing buffers and held on both sides by every core, is a large part of an executor's memory.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of a batch in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` of a frame; null texts become empty."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def fold(identifier: Column, folds: int) -> Column:
    """``crc32`` of the id as text modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(identifier.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def numbered(df: DataFrame, label: str, name: str = "row") -> DataFrame:
    """``df`` written once with a unique number per row."""
    return stage(df.withColumn(name, F.monotonically_increasing_id()), label)


def release_memory() -> None:
    """Hand freed memory back to the system.

    Python workers outlive their tasks and go on with those of later stages; without this,
    each would keep the peak of every stage it has worked for.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def steps(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each piece stay near ``STEP_BYTES``.

    A task begins and ends with the memory of no other.
    """
    release_memory()
    try:
        yield from _cut(batches, text)
    finally:
        release_memory()


def _cut(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).to_pylist()
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if total and total + (size or 0) > STEP_BYTES:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size or 0
        if start < len(sizes):
            yield batch.slice(start)


def add_columns(
    docs: DataFrame,
    kernel: Callable[[list[str]], Mapping[str, object]],
    fields: str,
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (or all) of ``docs`` and those that ``kernel`` makes of a list of texts.

    ``fields`` is the DDL of the new columns; a column of ``docs`` with the name of one is replaced.
    """
    extra = StructType.fromDDL(fields)
    names = [n for n in (docs.columns if keep is None else keep) if n not in extra.names]
    schema = StructType([docs.schema[n] for n in names] + extra.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in steps(batches, text_col):
            made = kernel([t or "" for t in batch.column(text_col).to_pylist()])
            columns = [batch.column(n) for n in names]
            columns += [pa.array(made[f.name], type=target.field(f.name).type) for f in extra.fields]
            yield pa.RecordBatch.from_arrays(
                [c if c.type == t.type else c.cast(t.type) for c, t in zip(columns, target)], schema=target
            )

    return docs.mapInArrow(run, schema)


def same_id(left: Column, right: Column) -> Column:
    """Equality that also holds between two null ids."""
    return left.eqNullSafe(right)


def restrict(docs: DataFrame, ids: DataFrame, how: str = "left_semi", id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose ``id_col`` is, or for ``left_anti`` is not, a ``doc_id`` of the written table ``ids``.

    The ids are broadcast only after they are measured.
    """
    ids = ids.select(F.col("doc_id").alias("_listed")).distinct()
    small = fits_in_memory(ids)
    return docs.join(F.broadcast(ids) if small else ids, same_id(docs[id_col], F.col("_listed")), how)


# --- hashed words ----------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
_MASK = (1 << 64) - 1
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, count: int) -> np.ndarray:
    """``base ** 0 … base ** (count - 1)`` modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < count:
        have = np.full(max(count, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:count]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts behind each other and the offsets of each; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or len(offsets) == 0:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array, letters: np.ndarray, single: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the first word of each text (one more at the end).

    With ``single``, every character of a script without spaces (Chinese characters, kana,
    Thai, Lao) is a word.

    ``letters`` maps each byte to the byte that is hashed, 0 for bytes between words. The
    hash is a polynomial in the word's bytes, taken from running sums over all texts.
    """
    data, offsets = text_bytes(texts)
    mapped = letters[data]
    inside = np.empty(len(mapped) + 1, bool)
    inside[:-1], inside[-1] = mapped != 0, False
    cut = np.zeros(len(mapped) + 1, bool)
    cut[offsets] = True
    if single:
        # in UTF-8 these characters have three bytes: E3 to E9 first, or E0 before B8 to BB
        alone = np.flatnonzero((data >= 0xE3) & (data <= 0xE9))
        other = np.flatnonzero(data == 0xE0)
        other = other[(data[other + 1] >= 0xB8) & (data[other + 1] <= 0xBB)]
        for lead in (alone, other):
            cut[lead], cut[lead + 3] = True, True
    before = np.empty(len(mapped), bool)
    before[:1], before[1:] = False, inside[: max(0, len(mapped) - 1)]
    starts = np.flatnonzero(inside[:-1] & (~before | cut[:-1]))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut[1:])) + 1
    sums = np.zeros(len(mapped) + 1, np.uint64)
    np.cumsum(mapped * _powers_of(_BASE, len(mapped)), out=sums[1:], dtype=np.uint64)
    inverse = _powers_of(pow(_BASE, -1, 1 << 64), len(mapped))
    return mix((sums[ends] - sums[starts]) * inverse[starts]), np.searchsorted(starts, offsets)


def plain_letters() -> np.ndarray:
    """Words between ASCII white space, ASCII letters in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    table[[0x20, *range(0x09, 0x0E)]] = 0
    return table


def alphanumeric_letters() -> np.ndarray:
    """Words of ASCII letters and digits and of all characters beyond ASCII, in lower case."""
    table = plain_letters()
    other = [b for b in range(128) if not chr(b).isalnum()]
    table[other] = 0
    return table
