"""Counts of tokens and of neighbouring tokens within Arrow batches.

Tokens are dictionary-encoded, so strings are touched once per distinct token of a batch;
counting, and telling which n-grams can be frequent at all, is done on numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

# Bits of the filter of frequent n-grams: 8 MB whatever the data. A fuller filter lets more
# n-grams through to be counted; it never changes a count.
FILTER_BITS = 1 << 26
_BITS_PER_PIECE = 32768

# Tokens of the lists that one step of a Python worker counts, and bytes of the texts it
# reads: its arrays stay near these, unless one list or text alone is longer.
STEP_TOKENS = 400_000
STEP_BYTES = 4_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def in_steps(column: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """Cut token lists, or texts, into stretches of at most ``most`` tokens or bytes, one row at least.

    The rows of an Arrow batch are bounded by their number, so its tokens grow with the
    input until batches are full; what a step makes of them does not.
    """
    lists = pa.types.is_list(column.type)
    most = most or (STEP_TOKENS if lists else STEP_BYTES)
    sizes = pc.fill_null(pc.list_value_length(column) if lists else pc.binary_length(column), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield column.slice(start, end - start)
        start = end


def by_steps(column: pa.Array, kernel: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``kernel`` of a column, which treats rows one by one, taken step by step."""
    made = [kernel(step) for step in in_steps(column)]
    return pa.concat_arrays(made) if made else kernel(column)


def token_hashes(tokens: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.array(tokens.to_pylist(), object), categorize=False)


def extended(hashes: np.ndarray, following: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(29))) * _ODD + following
    return mixed ^ (mixed >> np.uint64(32))


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes * _ODD) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


def _coded(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens, the code of every token (-1 for null) and its row."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    codes = pc.fill_null(coded.indices.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
    return coded.dictionary, codes, np.repeat(np.arange(len(lengths)), lengths)


def count_grams_batch(lists: pa.Array, n: int, frequent: np.ndarray | None = None) -> pa.RecordBatch:
    """``(w1, …, wn, n)`` of the n-grams of a batch of token lists.

    ``frequent`` is a bitmap of the frequent n-grams that are shorter by one; an n-gram with
    a part outside it cannot be frequent and is left out. Null tokens take part in none.
    """
    tokens, codes, row = _coded(lists)
    places = np.arange(max(0, len(codes) - n + 1))
    whole = row[places] == row[places + n - 1]
    for k in range(n):
        whole &= codes[places + k] >= 0
    places = places[whole]
    if frequent is not None and len(places):
        known = token_hashes(tokens)[np.maximum(codes, 0)]
        for shift in (0, 1):
            hashes = known[places + shift]
            for k in range(1, n - 1):
                hashes = extended(hashes, known[places + shift + k])
            slots = _slots(hashes, 8 * len(frequent))
            places = places[(frequent[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1]
    names = codes[places]
    for k in range(1, n):
        # dense numbers of the parts so far keep the product small
        names = np.unique(names, return_inverse=True)[1] * np.int64(len(tokens) + 1) + codes[places + k]
    _, first, counts = np.unique(names, return_index=True, return_counts=True)
    columns = [tokens.take(pa.array(codes[places[first] + k])) for k in range(n)]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array(counts.astype(np.int64))], names=[*(f"w{k}" for k in range(1, n + 1)), "n"]
    )


def count_grams(lists: DataFrame, n: int, frequent: Broadcast[np.ndarray] | None = None) -> DataFrame:
    """``(w1, …, wn, n)`` over a frame of one column of token lists."""
    schema = ", ".join([*(f"w{k} string" for k in range(1, n + 1)), "n long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = None if frequent is None else frequent.value
        for batch in batches:
            for lists in in_steps(batch.column(0)):
                yield count_grams_batch(lists, n, bitmap)

    words = [f"w{k}" for k in range(1, n + 1)]
    return lists.mapInArrow(run, schema).groupBy(*words).agg(F.sum("n").alias("n"))


def count_terms_batch(lists: pa.Array) -> pa.RecordBatch:
    """``(term, doc_freq, term_freq)`` of the tokens of a batch of lists, a document each."""
    tokens, codes, row = _coded(lists)
    row, codes = row[codes >= 0], codes[codes >= 0]
    in_rows = np.unique(row * np.int64(len(tokens) + 1) + codes) % (len(tokens) + 1)
    counts = (np.bincount(c, minlength=len(tokens)) for c in (in_rows, codes))
    return pa.RecordBatch.from_arrays(
        [tokens, *(pa.array(c.astype(np.int64)) for c in counts)], names=["term", "doc_freq", "term_freq"]
    )


def count_terms(lists: DataFrame) -> DataFrame:
    """``(term, doc_freq, term_freq)`` over a frame of one column of token lists, a document per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lists in in_steps(batch.column(0)):
                yield count_terms_batch(lists)

    made = lists.mapInArrow(run, "term string, doc_freq long, term_freq long")
    return made.groupBy("term").agg(F.sum("doc_freq").alias("doc_freq"), F.sum("term_freq").alias("term_freq"))


def gram_filter(grams: DataFrame, words: list[str], bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of ``bits`` bits of the n-grams in the columns ``words``.

    It is put together by slots, so that only the bitmap itself reaches the driver.
    """

    @F.arrow_udf(LongType())
    def slot(*parts: pa.Array) -> pa.Array:
        hashes = token_hashes(parts[0])
        for part in parts[1:]:
            hashes = extended(hashes, token_hashes(part))
        return pa.array(_slots(hashes, bits))

    pieces = (
        grams.select(slot(*(F.col(w) for w in words)).alias("slot"))
        .groupBy(F.expr(f"slot div {_BITS_PER_PIECE}").alias("piece"))
        .agg(F.bitmap_construct_agg(F.expr(f"slot % {_BITS_PER_PIECE}")).alias("bits"))
    )
    out = np.zeros(bits // 8, np.uint8)
    for row in pieces.collect():  # bits / 8 bytes at most
        at = row.piece * _BITS_PER_PIECE // 8
        out[at : at + _BITS_PER_PIECE // 8] = np.frombuffer(row.bits, np.uint8)[: len(out) - at]
    return out


def row_counts_batch(lists: pa.Array) -> pa.Array:
    """Per list its distinct tokens with their counts, in the order of first occurrence in the batch."""
    tokens, codes, row = _coded(lists)
    row, codes = row[codes >= 0], codes[codes >= 0]
    names, counts = np.unique(row * np.int64(len(tokens) + 1) + codes, return_counts=True)
    found, code = np.divmod(names, len(tokens) + 1)
    structs = pa.StructArray.from_arrays(
        [tokens.take(pa.array(code)), pa.array(counts.astype(np.int64))], names=["term", "n"]
    )
    ends = np.searchsorted(found, np.arange(len(lists) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), structs, mask=lists.is_null())


_COUNTED = ArrayType(StructType([StructField("term", StringType()), StructField("n", LongType())]))


def row_counts(tokens: Column) -> Column:
    """``array<struct<term, n>>``: the distinct tokens of a list with their counts."""

    @F.arrow_udf(_COUNTED)
    def apply(lists: pa.Array) -> pa.Array:
        return by_steps(lists, row_counts_batch)

    return apply(tokens)


def found_phrases(phrases: list[str]) -> Callable[[str], list[int]]:
    """A function that gives the places of the phrases that may come to occur in a text.

    One pass of an automaton finds all of them. Underscores count as spaces there: joining a
    phrase only turns spaces into underscores, so what occurs after any number of joins
    occurs in this reading from the start.
    """
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for place, phrase in enumerate(phrases):
        # phrases that read alike share an entry
        automaton.add_word(phrase.replace("_", " "), (*automaton.get(phrase.replace("_", " "), ()), place))
    automaton.make_automaton()

    def find(text: str) -> list[int]:
        hits = {entry for _, entry in automaton.iter(text.replace("_", " "))}
        return sorted(place for entry in hits for place in entry)

    return find
