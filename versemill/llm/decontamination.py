"""Benchmark passages in documents: latent semantic search, then common subsequence and answer checks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.llm.common import alphanumeric_letters, mix, read_documents, restrict, steps, word_hashes
from versemill.llm.svd import right_singular_vectors
from versemill.staging import stage

# Rank of the latent space of a block, and passages of a block on average: a worker holds
# the space of one block, at most 64 x 1024 words x 96 numbers.
RANK, BLOCK_PASSAGES = 96, 1024

# Cosine from which a window is a candidate; common subsequence and share of the answer
# words, as parts of the passage, from which a candidate is confirmed.
LEAST_COSINE, LEAST_COMMON, LEAST_ANSWER = 0.3, 0.65, 0.5

# Cosines of windows with passages held at once.
_COSINES = 500_000

# Words of an answer: the most informative ones of a passage.
ANSWER_WORDS = 4

# Shorter items are common phrases: they are sought as they stand, without a paraphrase.
# Longer ones than the second are cut.
LEAST_WORDS, MOST_WORDS = 8, 64

# Windows are built from blocks of this many words; each passage is sought with the
# shortest window that holds it, moved by the step beside it.
_BLOCK = 4
_WINDOWS = {16: 4, 24: 8, 32: 8, 48: 12, 64: 16}


def read_passages(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, words array<long>)``: all items as hashed words, in passages of at most ``MOST_WORDS``.

    A longer item is cut into passages of near equal length; equal rows count once, items
    without words not at all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = alphanumeric_letters()
        for batch in steps(batches):
            hashes, firsts = word_hashes(batch.column("text"), letters, single=True)
            places, passages = [], []
            for i in range(batch.num_rows):
                own = hashes[firsts[i] : firsts[i + 1]].view(np.int64)
                parts = np.array_split(own, -(-len(own) // MOST_WORDS)) if len(own) else []
                places += [i] * len(parts)
                passages += parts
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(places, pa.int64())), pa.array(passages, pa.list_(pa.int64()))],
                names=["item", "words"],
            )

    rows = read_documents(benchmark, id_col, text_col)
    return rows.mapInArrow(run, "item long, words array<long>").distinct()


class Vocabulary:
    """The different words of some passages, numbered by their hashes."""

    def __init__(self, words: np.ndarray):
        self.words = np.unique(words)
        self._maybe = np.zeros(1 << 16, bool)
        self._maybe[self.words & np.uint64(0xFFFF)] = True

    def __len__(self) -> int:
        return len(self.words)

    def number(self, words: np.ndarray) -> np.ndarray:
        """The number of each word; ``len(self)`` for words of no passage."""
        out = np.full(len(words), len(self.words), np.int32)
        if len(self.words):
            some = np.flatnonzero(self._maybe[words & np.uint64(0xFFFF)])
            at = np.minimum(np.searchsorted(self.words, words[some]), len(self.words) - 1)
            known = self.words[at] == words[some]
            out[some[known]] = at[known]
        return out


@dataclass
class Passages:
    """One block of benchmark passages as numbered words; ``items`` names the item of each."""

    items: list[int | None]
    words: list[np.ndarray]
    vocabulary: Vocabulary

    @classmethod
    def of(cls, items: list[int | None], words: list[np.ndarray]) -> "Passages":
        """From hashed words."""
        vocabulary = Vocabulary(np.concatenate(words) if words else np.empty(0, np.uint64))
        return cls(items, [vocabulary.number(w) for w in words], vocabulary)

    @classmethod
    def read(cls, block: DataFrame) -> "Passages":
        """The passages of one block of ``read_passages``, a bounded number of rows."""
        rows = sorted(block.collect(), key=lambda r: (r["item"] is None, r["item"], r["words"]))
        return cls.of([r["item"] for r in rows], [np.array(r["words"], np.int64).view(np.uint64) for r in rows])


def _document_frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """In how many of all documents each word of the vocabulary occurs, and their number."""
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total, count = alphanumeric_letters(), np.zeros(size + 1, np.int64), 0
        for batch in steps(batches):
            hashes, firsts = word_hashes(batch.column("text"), letters, single=True)
            numbers = vocabulary.number(hashes)
            known = np.flatnonzero(numbers < size)
            owner = np.searchsorted(firsts, known, side="right") - 1
            keys = np.unique(owner * size + numbers[known])
            total[:size] += np.bincount(keys % size, minlength=size)
            count += batch.num_rows
        total[size] = count
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], names=["word", "n"]
        )

    parts = docs.mapInArrow(run, "word int, n long")
    out = np.zeros(size + 1, np.int64)
    for row in parts.groupBy("word").agg(F.sum("n").alias("n")).collect():  # words of one block at most
        out[row["word"]] = row["n"]
    return out[:size], int(out[size])


@dataclass
class LatentSpace:
    """Weighted projection of each word: inverse document frequency times scaled singular vector.

    The last row is that of words of no passage: nothing.
    """

    projection: np.ndarray
    information: np.ndarray

    def of(self, words: np.ndarray) -> np.ndarray:
        return self.projection[words]


def fit_latent_space(docs: DataFrame, block: DataFrame, passages: Passages, rank: int = RANK) -> LatentSpace:
    """Document frequencies over all documents; singular vectors of all passages of the block.

    Words of no passage have no part in the space, so what surrounds a passage in a
    document turns its window aside only by the words that other passages share.
    """
    frequency, count = _document_frequencies(docs, passages.vocabulary)
    information = np.log((count + 2) / (frequency + 1)).astype(np.float32)
    vocabulary = passages.vocabulary

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vocabulary.number(np.array(w, np.int64).view(np.uint64)) for w in batch.column("words").to_pylist()]
            weights = [information[f] for f in found]
            weights = [w / (np.linalg.norm(w) + 1e-9) for w in weights]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float32()))],
                names=["features", "weights"],
            )

    matrix = stage(block.select("words").mapInArrow(weigh, "features array<int>, weights array<float>"), "latent-matrix")
    vectors, values = right_singular_vectors(matrix, len(vocabulary), rank)
    projection = np.zeros((len(vocabulary) + 1, vectors.shape[1]), np.float32)
    projection[:-1] = vectors / np.maximum(values, 1e-9).astype(np.float32) * information[:, None]
    return LatentSpace(projection, information)


def common_subsequence(left: list[int], right: list[int]) -> int:
    """Length of the longest common subsequence, one word of ``right`` at a time on a bit row."""
    masks: dict[int, int] = {}
    for i, word in enumerate(left):
        masks[word] = masks.get(word, 0) | 1 << i
    row = full = (1 << len(left)) - 1
    for word in right:
        hit = row & masks.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(left) - row.bit_count()


def _sequences(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` words from every place on; places without so many have none."""
    out = np.zeros(max(0, len(words) - length + 1), np.uint64)
    for k in range(length):
        out = mix(out + words[k : k + len(out)].astype(np.uint64) + np.uint64(1))
    return out


class _Searcher:
    """The passages in the latent space, and the check of a candidate window."""

    def __init__(self, passages: Passages, space: LatentSpace, least_cosine: float = LEAST_COSINE):
        self._space = space
        self._least_cosine = least_cosine
        self._items = passages.items
        self._passages = passages.words
        self._words = [p.tolist() for p in passages.words]
        self._answers = []
        for p in passages.words:
            distinct = np.unique(p)
            self._answers.append(
                set(distinct[np.argsort(-space.information[distinct], kind="stable")[:ANSWER_WORDS]].tolist())
            )
        pairs = sorted((word, i) for i, words in enumerate(self._answers) for word in words)
        self._answer_owner = np.array([p[1] for p in pairs], np.int64)
        # the owners of word w stand from place w on to place w + 1
        self._answer_begin = np.searchsorted(
            np.array([p[0] for p in pairs], np.int64), np.arange(len(passages.vocabulary) + 2)
        )
        self._least_hits = np.array([math.ceil(LEAST_ANSWER * len(a)) for a in self._answers], np.int64)
        self._sizes = np.array([len(w) for w in self._words], np.int64)
        self._groups = []
        for least, window in zip((LEAST_WORDS - 1, *_WINDOWS), _WINDOWS):
            members = [i for i, w in enumerate(self._words) if least < len(w) <= window]
            if members:
                vectors = np.stack([space.of(passages.words[i]).sum(axis=0) for i in members])
                vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9
                self._groups.append((window, np.array(members), np.ascontiguousarray(vectors.T)))
        self._short: dict[int, dict[int, list[int]]] = {}
        for i, p in enumerate(passages.words):
            if len(p) < LEAST_WORDS:
                self._short.setdefault(len(p), {}).setdefault(int(_sequences(p, len(p))[0]), []).append(i)

    def short_items(self, words: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, int]]:
        """``(text, passage)`` of passages under ``LEAST_WORDS`` words that stand in a text as they are."""
        for length, known in self._short.items():
            made = _sequences(words, length)
            places = np.flatnonzero(np.isin(made, np.array(list(known), np.uint64)))
            texts = np.searchsorted(firsts, places, side="right") - 1
            for place, text in zip(places.tolist(), texts.tolist()):
                if place + length <= firsts[text + 1]:
                    own = words[place : place + length]
                    for passage in known[int(made[place])]:
                        if np.array_equal(self._passages[passage], own):
                            yield text, passage

    def _answer_places(self, words: np.ndarray) -> np.ndarray:
        """Every place of an answer word as passage * number of words + place, sorted."""
        count = self._answer_begin[words + 1] - self._answer_begin[words]
        places = np.flatnonzero(count)
        low, count = self._answer_begin[words[places]], count[places]
        at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.sort(self._answer_owner[at] * (len(words) + 1) + np.repeat(places, count))

    def near(
        self, words: np.ndarray, firsts: np.ndarray
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``(words of a window, text, first word, passage, cosine)`` of all windows near a passage, in pieces."""
        blocks = -(-np.diff(firsts) // _BLOCK)
        text = np.repeat(np.arange(len(blocks)), blocks)
        first_block = np.cumsum(blocks) - blocks
        begin = firsts[:-1][text] + _BLOCK * (np.arange(len(text)) - first_block[text])
        if not len(begin) or not self._groups:
            return
        sums = np.zeros((len(begin) + 1, self._space.projection.shape[1]), np.float32)
        for at in range(0, len(begin), 2048):
            end = begin[at + 2048] if at + 2048 < len(begin) else len(words)
            some = self._space.of(words[begin[at] : end])
            sums[at + 1 : at + 2049] = np.add.reduceat(some, begin[at : at + 2048] - begin[at], axis=0)
        # running sums of the deviations from the mean stay small and exact enough
        mean = sums[1:].mean(axis=0)
        sums[1:] -= mean
        np.cumsum(sums, axis=0, out=sums)
        last_block = first_block + blocks
        inside = np.arange(len(begin)) - first_block[text]
        for window, members, vectors in self._groups:
            span, step = window // _BLOCK, _WINDOWS[window] // _BLOCK
            # the last window reaches the end of the text; a text shorter than a window is one
            starts = np.flatnonzero((inside % step == 0) & ((inside + span - step < blocks[text]) | (inside == 0)))
            size = min(16384, max(1, _COSINES // len(members)))
            for at in range(0, len(starts), size):
                some = starts[at : at + size]
                ends = np.minimum(some + span, last_block[text[some]])
                total = sums[ends] - sums[some] + mean * (ends - some)[:, None].astype(np.float32)
                total /= np.linalg.norm(total, axis=1, keepdims=True) + 1e-9
                cosine = total @ vectors
                near, column = np.nonzero(cosine >= self._least_cosine)
                block = some[near]
                yield window, text[block], begin[block], members[column], cosine[near, column]

    def candidates(self, words: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """``(text, first word of the window, passage, cosine)`` of windows to confirm.

        Of the windows near a passage, those stay around which at least ``LEAST_ANSWER`` of
        its answer words occur, counted with repeats.
        """
        answers = self._answer_places(words)
        for window, text, begin, passage, cosine in self.near(words, firsts):
            margin, row = self._sizes[passage], passage * (len(words) + 1)
            low = np.maximum(firsts[text], begin - margin)
            high = np.minimum(firsts[text + 1], begin + window + margin)
            hits = np.searchsorted(answers, row + high) - np.searchsorted(answers, row + low)
            stay = np.flatnonzero(hits >= self._least_hits[passage])
            yield from zip(*(found[stay].tolist() for found in (text, begin, passage, cosine)))

    def confirm(self, words: np.ndarray, first: int, last: int, begin: int, passage: int) -> tuple[float, float]:
        """Common subsequence and answer share of a passage around the window at ``begin``."""
        own = self._words[passage]
        margin = len(own)
        around = words[max(first, begin - margin) : min(last, begin + _window_of(len(own)) + margin)].tolist()
        answers = self._answers[passage]
        share = len(answers.intersection(around)) / len(answers)
        if share < LEAST_ANSWER:
            return 0.0, share
        return common_subsequence(own, around) / len(own), share

    def item(self, passage: int) -> int:
        return self._items[passage]


def _window_of(length: int) -> int:
    return next(w for w in _WINDOWS if length <= w)


_FOUND = "item_id long, cosine double, common double, answer double"


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document and benchmark item that it holds: ``doc_id, item_id, cosine, common, answer``.

    Items are cut into passages of up to 64 words, dealt into blocks by hash. Per block, all
    windows of all documents are projected into the latent space of its passages and
    compared with those of their length class; candidates are confirmed by the longest
    common subsequence of words (at least 0.65 of the passage) and by its most informative
    words (at least half of them). Words are runs of letters and digits, in lower case; in
    scripts without spaces every character is a word. Items under 8 words are found where
    their words stand one behind the other, with the cosine 1. Empty and null texts are
    never found; an empty benchmark or document table gives no rows, rows that repeat an id
    are searched each and reported once, and a null id is reported as null.
    """
    rows = read_documents(docs, id_col, text_col)
    passages = stage(read_passages(benchmark, item_col, item_text_col), "passages")
    blocks = -(-passages.count() // BLOCK_PASSAGES)
    if not blocks:
        return rows.select("doc_id").limit(0).selectExpr(
            "doc_id", "CAST(NULL AS long) AS item_id", *(f"CAST(NULL AS double) AS {n}" for n in ("cosine", "common", "answer"))
        )
    block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    found = [_find_block(rows, passages.where(block == b)) for b in range(blocks)]
    found = reduce(DataFrame.unionAll, found)
    return found.groupBy("doc_id", "item_id").agg(*(F.max(n).alias(n) for n in ("cosine", "common", "answer")))


def _find_block(rows: DataFrame, block: DataFrame) -> DataFrame:
    """Documents with passages of one block: ``doc_id, item_id, cosine, common, answer`` with repeats."""
    passages = Passages.read(block)
    space = fit_latent_space(rows, block, passages)
    shared = rows.sparkSession.sparkContext.broadcast((passages, space))  # words of a block x rank numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher, letters = _Searcher(*shared.value), alphanumeric_letters()
        vocabulary = shared.value[0].vocabulary
        for batch in steps(batches):
            hashes, firsts = word_hashes(batch.column("text"), letters, single=True)
            words = vocabulary.number(hashes)
            ids = batch.column("doc_id")
            best = {(text, searcher.item(p)): (1.0, 1.0, 1.0) for text, p in searcher.short_items(words, firsts)}
            for text, begin, passage, cosine in searcher.candidates(words, firsts):
                key = (text, searcher.item(passage))
                if key in best and best[key][0] == 1.0:
                    continue
                common, answer = searcher.confirm(words, firsts[text], firsts[text + 1], begin, passage)
                if common >= LEAST_COMMON and answer >= LEAST_ANSWER:
                    best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (common, cosine, answer))
            keys = list(best)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array([k[0] for k in keys], pa.int64())),
                    pa.array([k[1] for k in keys], pa.int64()),
                    *(pa.array([best[k][i] for k in keys], pa.float64()) for i in (1, 0, 2)),
                ],
                names=["doc_id", "item_id", "cosine", "common", "answer"],
            )

    return rows.mapInArrow(run, "doc_id long, " + _FOUND)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns pass unchanged."""
    found = stage(find_contamination(docs, benchmark, id_col, text_col).select("doc_id"), "contaminated")
    return restrict(docs, found, "left_anti", id_col)
