"""Periodic runs of words: maximal stretches that repeat a root of words four times or more."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from versemill.llm.common import mix, read_documents, steps
from versemill.llm.lce import Extensions, longest_lyndon

# A run has at least this many words and holds its root at least so many times.
LEAST_WORDS, LEAST_POWER = 6, 4

# Words of the grams that select the stretches; every run repeats one of them (see _stretches).
GRAM = LEAST_WORDS - 1

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def find_runs(symbols: np.ndarray, least: int = LEAST_WORDS, power: int = LEAST_POWER) -> np.ndarray:
    """Rows ``(start, length, period)`` of the runs of a sequence of numbers from 1 on, in order.

    The root of a run, rotated to a Lyndon word, is the longest Lyndon word at its place in
    one of the two orders of the symbols; so each place gives two candidates, which are
    extended in both directions by common extensions in the sequence and in its reversal.
    A Lyndon word is no power, so its length is the smallest period of what it extends to.
    Period and extension are linear in the sequence, in time and memory.
    """
    size = len(symbols)
    if size < max(least, power):
        return np.empty((0, 3), np.int64)
    ahead = Extensions(symbols)
    starts, periods = [], []
    for falling in (False, True):
        lengths = longest_lyndon(ahead.ranks(falling))
        at = np.flatnonzero(lengths * power <= size)
        starts.append(at)
        periods.append(lengths[at])
    start, period = np.concatenate(starts), np.concatenate(periods)
    right = ahead.common(start, start + period)
    # what cannot reach the length even if it began at 0 needs no second question
    hopeful = start + period + right >= np.maximum(least, power * period)
    start, period, right = start[hopeful], period[hopeful], right[hopeful]
    del ahead
    back = Extensions(symbols[::-1])
    left = back.common(size - start, size - start - period)
    found = np.stack([start - left, left + period + right, period], axis=1)
    found = found[found[:, 1] >= np.maximum(least, power * period)]
    return np.unique(found, axis=0)[:, :3]


def _stretches(codes: np.ndarray) -> np.ndarray:
    """Places of the words that some repeated gram covers, a superset of all runs.

    A run of period q and length L >= max(6, 4 q) equals itself shifted by q, in L - q >= 5
    words, at least 3 q. So each of its words lies in a gram of 5 that the document repeats,
    and a neighbour that extended the run would lie in one too.
    """
    windows = len(codes) - GRAM + 1
    if windows < 2:
        return np.empty(0, np.int64)
    grams = np.zeros(windows, np.uint64)
    words = codes.astype(np.uint64)
    for k in range(GRAM):
        grams = mix(grams + words[k : k + windows])
    order = np.argsort(grams)
    ranked = grams[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return np.empty(0, np.int64)
    repeated = np.zeros(windows, bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    covered = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(repeated)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + GRAM, -1)
    return np.flatnonzero(np.cumsum(covered[:-1]) > 0)


def word_runs(codes: np.ndarray) -> np.ndarray:
    """``(start, length, period)`` of the runs of a document's word numbers, in order.

    Only stretches of repeated grams enter the trees, joined by symbols that occur once and
    so end every extension.
    """
    places = _stretches(codes)
    if len(places) < LEAST_WORDS:
        return np.empty((0, 3), np.int64)
    cuts = np.flatnonzero(np.diff(places) > 1) + 1
    known, symbols = np.unique(codes[places], return_inverse=True)
    joints = len(known) + 1 + np.arange(len(cuts))
    found = find_runs(np.insert(symbols + 1, cuts, joints))
    # back to places in the document
    origin = np.insert(places, cuts, -1)
    found[:, 0] = origin[found[:, 0]]
    return found


def repeat_tail(words: list[bytes], number: int) -> list[bytes]:
    """Words with the tail from a place on made periodic, place and period taken from ``number``."""
    size = len(words)
    if not size:
        return words
    at = number % size
    period = 1 + (size - at) // (3 + number % 8)
    root = words[at : at + period]
    times = -(-(size - at) // period)
    return words[:at] + (root * times)[: size - at]


def describe(words: list[bytes]) -> tuple:
    """``n_runs``, the longest run, and digests of all runs and of the words that are left."""
    numbers = defaultdict(count(1).__next__)
    codes = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    found = word_runs(codes)
    if not len(found):
        return 0, None, None, None, None, hashlib.sha256().hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, found[:, 0] + found[:, 2], 1)
    np.add.at(dropped, found[:, 0] + found[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(dropped[:-1]) == 0).tolist()
    start, length, period = found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]].tolist()
    return (
        len(found), start, length, period, 1000 * length // period,
        hashlib.sha256(lines.encode()).hexdigest(),
        hashlib.sha256(b" ".join([words[k] for k in kept])).hexdigest(),
    )


_FIELDS = (
    "n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", probe: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id, its number of runs, the longest one and two digests.

    A run is a stretch of consecutive words (between ASCII white space) with smallest period
    ``q`` and at least ``max(6, 4 q)`` words that no neighbour extends. Of equally long runs
    the first counts, then the one of the smaller period. ``collapsed_sha256`` is that of
    the words joined by one space without those that lie in a run after its first ``q``.
    Null and empty texts have no words and no runs; texts without runs have nulls for the
    longest one. Rows are independent: repeated rows and ids give a row each, null ids stay
    null, an empty table an empty result, and other columns are not read. A text's trees
    take some hundred bytes per word that lies in a repeated gram, and are dropped with it.

    ``probe`` first makes the tail of every tenth document periodic, chosen by crc32 of its
    id (a null id counts as the empty text), so that runs are known to exist.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        for batch in steps(batches):
            made = []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = _WORD.findall(text.encode())
                number = zlib.crc32(b"" if i is None else str(i).encode())
                if probe and number % 10 == 0:
                    words = repeat_tail(words, number // 10)
                made.append(describe(words))
            columns = zip(*made) if made else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", *names]
            )

    return read_documents(docs, id_col, text_col).mapInArrow(run, f"doc_id long, {_FIELDS}")
