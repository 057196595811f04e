"""Similar texts by the Jaccard similarity of their word n-grams, through trees of count vectors.

The n-grams of a text are hashed into groups. Where two sets are similar enough, fewer
n-grams differ than there are groups, so they agree in some group as a whole: texts meet in
the blocks of equal groups. Within a block the counts per group are points of an R-tree,
whose join with itself bounds the overlap by the summed minima of the coordinates, and what
survives is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.joins import fits_in_memory, join_lookup
from versemill.llm.common import mix, numbered, read_documents, restrict, steps
from versemill.llm.components import connected_components
from versemill.llm.count_tree import CountTree, least_common
from versemill.llm.minhash import Shingler, set_key
from versemill.staging import stage

# Coordinates of a count vector; one more holds what exceeds a byte in any of them.
COORDINATES = 256

# Blocks with more classes first get links to one of them, in at most so many rounds; blocks
# with more than a tile are split, so that a task holds at most two tiles of a block.
HUB, ROUNDS, TILE = 32, 3, 4096


@lru_cache(maxsize=None)
def _bands(percent: int) -> list[int]:
    """Largest set size of each band; in the first one only equal sets are similar."""
    first = 1
    while 2 * (first + 1) * (100 - percent) // (100 + percent) < 1:
        first += 1
    limits = [first]
    while limits[-1] < 1 << 40:
        limits.append(limits[-1] * 3 // 2 + 1)
    return limits


def _group_keys(grams: np.ndarray, percent: int) -> np.ndarray:
    """Keys of which similar sets have one in common at least.

    Two sets of at most U members differ in at most ``d = 2 U (100 - p) / (100 + p)`` of them,
    so of ``d + 2`` groups they agree in two. A key names a group's members; groups without
    members are no keys, but any two of them are one. A pair meets in the band of its larger
    set, so a set has the keys of all bands that its partners can lie in.
    """
    limits, size, keys = _bands(percent), len(grams), []
    first = int(np.searchsorted(limits, size))
    last = int(np.searchsorted(limits, 100 * size // percent))
    for band in range(max(1, first), last + 1):
        groups = 2 * limits[band] * (100 - percent) // (100 + percent) + 2
        spread = mix(grams ^ np.uint64(0xA0761D6478BD642F))
        place = ((spread >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
        order = np.argsort(place, kind="stable")
        place = place[order]
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        named = place[starts]
        salt = np.uint64(band << 40)
        keys.append(mix(np.add.reduceat(spread[order], starts) + mix(named + salt)))
        if len(named) < groups - 1:
            empty = np.setdiff1d(np.arange(groups, dtype=np.uint64), named)
            one, other = np.triu_indices(len(empty), 1)
            keys.append(mix(mix(empty[one] + salt) + mix(mix(empty[other] + salt) + np.uint64(1))))
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def _counts(grams: np.ndarray) -> bytes:
    """The count vector in bytes; what a byte cannot hold is left to the size."""
    found = np.bincount((grams >> np.uint64(64 - COORDINATES.bit_length() + 1)).astype(np.int64), minlength=COORDINATES)
    return np.minimum(found, 255).astype(np.uint8).tobytes()


def _points(counts: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Vectors with the excess as a further coordinate, which keeps the bound above the overlap."""
    made = np.empty((len(counts), COORDINATES + 1), np.int32)
    made[:, :-1] = np.frombuffer(b"".join(counts), np.uint8).reshape(-1, COORDINATES)
    made[:, -1] = sizes - made[:, :-1].sum(axis=1)
    return made


_SIGNED = "doc_id long, n long, key1 long, key2 long, counts binary, keys array<long>"


def _sign(docs: DataFrame, words: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        for batch in steps(batches):
            made = [
                (len(g), *set_key(g), _counts(g), _group_keys(g, percent).view(np.int64))
                for g in shingler(batch.column("text"))
            ]
            columns = zip(*made) if made else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n", "key1", "key2", "counts", "keys"],
            )

    return docs.mapInArrow(run, _SIGNED)


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


class _Sets:
    """Texts with the same n-grams as one class, the blocks of classes, and the exact test."""

    def __init__(self, docs: DataFrame, words: int, percent: int):
        self._docs, self._words, self.percent = docs, words, percent
        self.signed = numbered(_sign(docs, words, percent), "join-signed")
        # the row with the smallest id stands for its class
        first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id"), F.col("row")))
        self.classes = stage(
            self.signed.groupBy("n", "key1", "key2").agg(first.getField("row").alias("class")), "join-classes"
        )
        members = self.signed.join(
            self.classes.where("n > 0").select("class"), F.col("row") == F.col("class"), "left_semi"
        )
        self.members = stage(members.withColumnRenamed("row", "class"), "join-members")

    def blocks(self) -> DataFrame:
        """``(key, class, n)`` of the blocks with several classes; of equal blocks one stays."""
        rows = self.members.select("class", "n", F.explode("keys").alias("key"))
        # a block's classes are named by two sums of 64 bits
        sizes = rows.groupBy("key").agg(
            F.count("*").alias("size"),
            F.bit_xor(F.xxhash64("class")).alias("one"),
            F.bit_xor(F.xxhash64("class", F.lit(1))).alias("two"),
        )
        kept = sizes.where("size > 1").groupBy("size", "one", "two").agg(F.min("key").alias("key"))
        return stage(join_lookup(rows, kept.select("key", "size"), ["key"], ["class"]), "join-blocks")

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``(a, b)`` whose summed minima reach the least overlap."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                sizes = [batch.column(f"n_{s}").to_numpy() for s in "ab"]
                one, other = (
                    _points(batch.column(f"counts_{s}").to_pylist(), n) for s, n in zip("ab", sizes)
                )
                bound = np.minimum(one, other).sum(axis=1, dtype=np.int64)
                keep = bound >= least_common(sizes[0] + sizes[1], percent)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

        for side in "ab":
            own = self.members.select(
                F.col("class").alias(side), F.col("n").alias(f"n_{side}"), F.col("counts").alias(f"counts_{side}")
            )
            pairs = pairs.join(own, side)
        return pairs.mapInArrow(run, "a long, b long")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The written pairs ``(a, b)`` that are links by their whole sets, written."""
        sets = self._whole(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct())
        for side in "ab":
            pairs = pairs.join(sets.select(F.col("class").alias(side), F.col("grams").alias(f"set_{side}")), side)
        common = F.size(F.array_intersect("set_a", "set_b"))
        linked = 100 * common >= self.percent * (F.size("set_a") + F.size("set_b") - common)
        return stage(pairs.where(linked).select("a", "b"), "join-links")

    def _whole(self, classes: DataFrame) -> DataFrame:
        """``(class, grams)``, read once more from the first document of each class, and written."""
        named = stage(
            self.members.join(classes, "class", "left_semi").select("class", "doc_id", "key1", "key2", "n"), "join-named"
        )
        words = self._words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler = Shingler(words)
            for batch in steps(batches):
                made = [(len(g), *set_key(g), g.view(np.int64)) for g in shingler(batch.column("text"))]
                columns = zip(*made) if made else [[]] * 4
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["n", "key1", "key2", "grams"]
                )

        keys = ["n", "key1", "key2"]
        read = restrict(self._docs, named).mapInArrow(run, "n long, key1 long, key2 long, grams array<long>")
        # ids that repeat give some sets more than once
        found = read.join(named.drop("doc_id"), keys).select("class", "grams").dropDuplicates(["class"])
        return stage(found, "join-sets")


def _mixed(blocks: DataFrame, joined: DataFrame | None) -> DataFrame:
    """``(key, class, n, size, component, outside)`` of the blocks with several components.

    ``outside`` tells that a class lies outside the largest component of its block.
    """
    if joined is None:
        placed = blocks.withColumn("component", F.col("class"))
    else:
        labels = joined.select(F.col("node").alias("class"), "component")
        labels = F.broadcast(labels) if fits_in_memory(labels) else labels
        placed = blocks.join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
    placed = stage(placed, "join-placed")
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("held"))
    main = (
        parts.groupBy("key")
        .agg(F.max_by("component", F.struct("held", "component")).alias("main"), F.count("*").alias("components"))
        .where("components > 1")
        .select("key", "main")
    )
    found = join_lookup(placed, main, ["key"], ["class"])
    return stage(found.withColumn("outside", F.col("component") != F.col("main")).drop("main"), "join-mixed")


def _similar_size(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _hub_pairs(found: _Sets, mixed: DataFrame) -> DataFrame:
    """Pairs of one class outside the main component with the other components, per large block."""
    large = mixed.where(F.col("size") > HUB)
    met = large.groupBy("class").agg(F.sum("size").alias("met"))
    ranked = large.where("outside").join(met, "class")
    # the class that meets the most others is the one that links the most
    hub = F.max(F.struct("met", F.xxhash64("class").alias("order"), "class", "component", "n")).alias("hub")
    hubs = ranked.groupBy("key").agg(hub).select(
        "key", F.col("hub.class").alias("hub"), F.col("hub.component").alias("hub_component"), F.col("hub.n").alias("hub_n")
    )
    pairs = join_lookup(large, hubs, ["key"], ["class"]).where(
        (F.col("component") != F.col("hub_component")) & _similar_size("n", "hub_n", found.percent)
    )
    return pairs.select(*_ordered(F.col("class"), F.col("hub"))).distinct()


def _tree_pairs(found: _Sets, mixed: DataFrame) -> DataFrame:
    """Pairs of different components that the trees of all blocks leave.

    A block of more than ``TILE`` classes is dealt into tiles by a hash of the class, and
    every two tiles are a block of their own.
    """
    own = F.pmod(F.xxhash64("class", "key"), F.col("tiles"))
    tiled = (
        mixed.join(found.members.select("class", "counts"), "class")
        .withColumn("tiles", F.ceil(F.col("size") / TILE).cast("long"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
        .select("key", "low", "high", "class", "n", "component", "counts")
    )
    percent = found.percent

    def search(block: pa.Table) -> pa.RecordBatch | None:
        classes, sizes = block["class"].to_numpy(), block["n"].to_numpy()
        tree = CountTree(_points(block["counts"].to_pylist(), sizes), sizes, block["component"].to_numpy())
        pairs = [(classes[i], classes[j]) for i, j in tree.pairs(percent)]
        if not pairs:
            return None
        one, other = (np.concatenate(side) for side in zip(*pairs))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other))], names=["a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # rows of the last block, which the next batch may go on with
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            names = np.stack([rows[c].to_numpy() for c in ("key", "low", "high")])
            cuts = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1
            edges = [0, *cuts.tolist()]
            for begin, end in zip(edges[:-1], edges[1:]):
                out = search(rows.slice(begin, end - begin))
                if out is not None:
                    yield out
            rest = rows.slice(edges[-1])
        if rest is not None and rest.num_rows:
            out = search(rest)
            if out is not None:
                yield out

    order = ["key", "low", "high"]
    return tiled.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long").distinct()


def similar_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90
) -> DataFrame:
    """One row per row of ``docs``: ``row, doc_id, n_shingles, component_id``.

    Two texts are linked when ``100 * intersection >= percent * union`` of their sets of word
    n-grams (words between ASCII white space, ASCII letters lowered; fewer words than an
    n-gram are one); ``component_id`` is the smallest id that links reach. Texts without
    words, and null texts, are linked with nothing. Null ids come last; a component of null
    ids has a null ``component_id``. Rows that repeat an id or a text each have their row,
    other columns are not read, and an empty table gives an empty result.

    Texts with equal sets are one class. Blocks of more than ``HUB`` classes are first linked
    with one class each, so that many copies of one text join in a number of pairs that grows
    with the copies; then the trees give every pair of classes that still lie in different
    components and may be similar. No pair is left out by chance: n-grams are told apart by 64
    bits, blocks and classes by 128.
    """
    found = _Sets(read_documents(docs, id_col, text_col), words, percent)
    blocks, joined = found.blocks(), None
    for _ in range(ROUNDS):
        mixed = _mixed(blocks, joined)
        if not mixed.where(F.col("size") > HUB).head(1):
            break
        joined = _joined(found, joined, found.bounded(stage(_hub_pairs(found, mixed), "join-hubs")))
    else:
        mixed = _mixed(blocks, joined)
    joined = _joined(found, joined, _tree_pairs(found, mixed))
    return _labelled(found, joined)


def _joined(found: _Sets, joined: DataFrame | None, pairs: DataFrame) -> DataFrame:
    """``(node, component)`` by the components so far and the links among ``pairs``."""
    links = found.verify(stage(pairs, "join-pairs"))
    if joined is not None:
        links = links.union(joined.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return stage(connected_components(links), "join-joined")


def _labelled(found: _Sets, joined: DataFrame) -> DataFrame:
    keys = ["n", "key1", "key2"]
    labels = found.classes.join(joined, F.col("class") == F.col("node"), "left").select(
        *keys, F.when(F.col("n") > 0, F.coalesce("component", "class")).alias("component")
    )
    rows = join_lookup(found.signed.select("row", "doc_id", *keys), labels, keys, ["row"])
    rows = stage(rows.select("row", "doc_id", F.col("n").alias("n_shingles"), "component"), "join-rows")
    # nulls are last by the flag before them
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id")))
    firsts = rows.where("component IS NOT NULL").groupBy("component").agg(first.alias("first"))
    return join_lookup(rows, firsts, ["component"], ["row"], "left").select(
        "row",
        "doc_id",
        "n_shingles",
        F.when(F.col("first").isNotNull(), F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
