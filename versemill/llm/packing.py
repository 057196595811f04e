"""Packing of tokenised documents into sequences by best-fit decreasing."""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.llm.common import numbered, read_documents, steps

# Pieces that one task packs; the number of bins follows from the data.
BIN_PIECES = 8192

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteTokenizer:
    """Ids of texts as bytes (32 bit, little-endian) for a byte-level BPE in merge order.

    The vocabulary of the ``tokenizers`` file is handed to ``tiktoken``, which gives the
    same ids several times faster. A text that holds the string of a special token goes to
    the tokenizer of the file itself, which is only loaded then.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self._path = path
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        added = {token["id"]: token["content"] for token in content["added_tokens"]}
        self._special = list(added.values())
        letters = _byte_letters()
        ranks = {
            bytes(letters[c] for c in token): rank
            for token, rank in content["model"]["vocab"].items()
            if rank not in added
        }
        self._fast = tiktoken.Encoding(
            "bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    @cached_property
    def _tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._path)

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self._special):
            return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self._fast.encode_ordinary(text)).tobytes()


@lru_cache(maxsize=1)
def byte_tokenizer(path: str) -> ByteTokenizer:
    """One tokenizer per process: tasks that follow each other share it."""
    return ByteTokenizer(path)


def _byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte.

    Printable bytes stand for themselves, the others take the letters from U+0100 on.
    """
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def cut_pieces(
    docs: DataFrame,
    tokenizer: str | None = None,
    window: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``window`` tokens: full windows of long documents, then the rest.

    Every document is tokenised whole and ends with ``end_id``, so an empty text has one
    token. ``with_ids`` adds the ids as bytes.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_tokenizer(path)
        end = array("I", [end_id]).tobytes()
        for batch in steps(batches):
            columns: list[list] = [[], [], [], [], [], []]
            doc_ids = batch.column("doc_id").to_pylist()
            for doc_id, text in zip(doc_ids, batch.column("text").to_pylist()):
                ids = tokens.encode(text) + end
                n = len(ids) // 4
                for start in range(0, n, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    row = (doc_id, start, len(piece) // 4, zlib.crc32(piece), n, piece)
                    for column, value in zip(columns, row):
                        column.append(value)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]]
            if with_ids:
                names, arrays = [*names, "ids"], [*arrays, pa.array(columns[5], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return read_documents(docs, id_col, text_col).mapInArrow(run, _PIECE + (", ids binary" if with_ids else ""))


class OpenWindows:
    """Open windows in a segment tree over their remaining capacity."""

    def __init__(self, window: int):
        self._leaves = 1 << max(1, window).bit_length()
        self._counts = [0] * (2 * self._leaves)
        self._windows: list[list[int]] = [[] for _ in range(self._leaves)]

    def add(self, capacity: int, window: int) -> None:
        self._windows[capacity].append(window)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self._leaves
        while node:
            self._counts[node] += by
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the window with the least capacity of at least ``need``."""
        counts, node = self._counts, need + self._leaves
        while not counts[node]:
            while node & 1:  # a right child: what lies to its right belongs to an ancestor
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self._leaves:
            node = 2 * node if counts[2 * node] else 2 * node + 1
        capacity = node - self._leaves
        self._change(capacity, -1)
        return capacity, self._windows[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window and offset of each piece; longer pieces first, ties in the given order."""
    windows, offsets = [0] * len(lengths), [0] * len(lengths)
    tree, opened = OpenWindows(window), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.tightest(lengths[i])
        if found is None:
            found, opened = (window, opened), opened + 1
        capacity, windows[i] = found
        offsets[i] = window - capacity
        if capacity > lengths[i]:
            tree.add(capacity - lengths[i], windows[i])
    return windows, offsets


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    window: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    bin_pieces: int = BIN_PIECES,
    with_ids: bool = False,
) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens.

    One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset`` and, on request, ``ids``. Pieces are dealt by a hash of their row to bins of
    about ``bin_pieces``, so a bin fits one task at any size and repeated ids do not meet;
    within a bin the longest piece goes first, into the open window with the least
    remaining room. Ties keep the order of the rows. Null texts are empty and have only the
    end token; an empty table has no pieces.
    """
    pieces = numbered(cut_pieces(docs, tokenizer, window, end_id, id_col, text_col, with_ids), "pieces", "_row")
    bins = max(1, -(-pieces.count() // bin_pieces))
    placed = pieces.schema.names[:-1]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "_row")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_row")
        windows, offsets = best_fit_decreasing(table.column("length").to_pylist(), window)
        first = key[0].as_py() << 32
        return (
            table.select(placed)
            .append_column("sequence_id", pa.array([first + w for w in windows], pa.int64()))
            .append_column("offset", pa.array(offsets, pa.int64()))
        )

    return (
        pieces.withColumn("_bin", F.pmod(F.xxhash64("_row"), F.lit(bins)))
        .groupBy("_bin")
        .applyInArrow(run, fields + ", sequence_id long, offset long")
    )
