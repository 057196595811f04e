"""Near-duplicates by banded minhashes, verified sequentially and then exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versemill.joins import fits_in_memory
from versemill.llm.common import (
    mix,
    numbered,
    plain_letters,
    read_documents,
    restrict,
    small_batches,
    steps,
    word_hashes,
)
from versemill.llm.components import connected_components
from versemill.staging import stage

# 30 bands of 5 rows: at a similarity of 0.8 a pair shares no band with probability 7e-6.
BANDS, ROWS = 30, 5

# Hashes that one step of the sequential test looks at, and the probability that a pair at
# the threshold is pruned.
STEP, MISS = 30, 1e-6

# Keys of twice a band's rows, for the classes that the bands leave in several components.
KEYS = 48

_BLOCK = 2048


@lru_cache(maxsize=4)
def _constants(count: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.Generator(np.random.PCG64(20240229))
    odd = random.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, random.integers(0, 1 << 63, count, dtype=np.uint64)


class Shingler:
    """Sets of hashed word shingles: ASCII lower case, words between ASCII white space."""

    def __init__(self, words: int):
        self._words = words
        self._weights = _constants(max(64, words))[0]
        self._letters = plain_letters()

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The distinct shingles of each text, sorted; fewer words than a shingle are one sequence."""
        hashes, firsts = word_hashes(texts, self._letters)
        full = self._hashed(hashes, self._words)
        out = []
        for begin, end in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
            if end - begin >= self._words:
                out.append(np.unique(full[begin : end - self._words + 1]))
            else:
                out.append(self._hashed(hashes[begin:end], end - begin)[: end > begin])
        return out

    def _hashed(self, hashes: np.ndarray, size: int) -> np.ndarray:
        total = np.full(max(0, len(hashes) - size + 1), size, np.uint64)
        for k in range(size):
            total = mix(total * self._weights[k] + hashes[k : len(total) + k])
        return total


def signature(shingles: np.ndarray, count: int) -> np.ndarray:
    """Minima of ``count`` hash functions, 32 bits each."""
    odd, add = _constants(count)
    low = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _BLOCK):
        block = shingles[at : at + _BLOCK, None] * odd[None, :]
        block += add[None, :]
        np.minimum(low, block.min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key per band; the band's number is part of it."""
    bands = len(minima) // rows
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for column in minima[: bands * rows].reshape(bands, rows).T.astype(np.uint64):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def _low_bits(minima: np.ndarray) -> list[int]:
    """The lowest bits of the first 128 minima as two numbers."""
    bits = np.packbits((minima[:128] & 1).astype(np.uint8))
    return np.frombuffer(bits.tobytes().ljust(16, b"\0"), np.int64).tolist()


_SIGNED = (
    "doc_id long, n long, key1 long, key2 long, low1 long, low2 long, bands array<long>, minima binary"
)


def sign(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of ``(doc_id, text)``: size and key of its shingle set, band keys and minima."""
    count = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in steps(batches):
            made = []
            for found in shingler(batch.column("text")):
                minima = signature(found, count)
                key1, key2 = set_key(found)
                low1, low2 = _low_bits(minima)
                full = len(found) > 0
                made.append(
                    (len(found), key1, key2, low1, low2, _band_keys(minima, rows) if full else [], minima.tobytes())
                )
            columns = list(zip(*made)) if made else [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.binary()]
            names = ["n", "key1", "key2", "low1", "low2", "bands", "minima"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds))],
                names=["doc_id", *names],
            )

    return docs.mapInArrow(run, _SIGNED)


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name a set."""
    with np.errstate(over="ignore"):
        first = mix(shingles).sum(dtype=np.uint64)
        second = mix(shingles ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    return int(first.view(np.int64)), int(second.view(np.int64))


def _tail(matches: int, trials: int, threshold: float) -> float:
    """Posterior probability that the similarity reaches ``threshold``, uniform beforehand.

    The beta distribution of integer parameters is a sum of binomial terms.
    """
    n = trials + 1
    logs = [
        math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        + k * math.log(threshold) + (n - k) * math.log1p(-threshold)
        for k in range(matches + 1)
    ]
    return sum(map(math.exp, logs))


@lru_cache(maxsize=64)
def least_matches(trials: int, threshold: float, miss: float) -> int:
    """Fewest matches among ``trials`` hashes with a posterior of at least ``miss``."""
    return next(m for m in range(trials + 1) if _tail(m, trials, threshold) >= miss or m == trials)


def _most_differing_bits(bits: int, threshold: float, miss: float) -> int:
    """Most differing low bits that a pair at the threshold has but for probability ``miss``.

    Bits of equal minima agree; of unequal ones every second bit does.
    """
    chance, total = (1 - threshold) / 2, 0.0
    for k in range(bits, -1, -1):
        total += math.comb(bits, k) * chance**k * (1 - chance) ** (bits - k)
        if total > miss:
            return k
    return 0


def _similar_size(a: Column, b: Column, percent: int) -> Column:
    """The similarity is at most the ratio of the sizes."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _sequential_test(pairs: DataFrame, count: int, percent: int, miss: float) -> DataFrame:
    """Pairs that stay after every step of hashes; columns ``a, b, minima_a, minima_b``."""
    limits = [(n, least_matches(n, percent / 100, miss)) for n in range(STEP, count + 1, STEP)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, count)
                for c in ("minima_a", "minima_b")
            )
            alive, matches, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
            for n, least in limits:
                matches = matches + (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
                stay = matches >= least
                alive, matches, done = alive[stay], matches[stay], n
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return pairs.mapInArrow(run, "a long, b long")


class _Classes:
    """Texts with the same shingle set as one class, and the exact test between classes."""

    def __init__(self, docs: DataFrame, words: int, percent: int, bands: int, rows: int, miss: float):
        self._docs, self._words, self.percent, self._miss = docs, words, percent, miss
        self.count = bands * rows
        self.signed = numbered(sign(docs, words, bands, rows), "signed")
        # the row with the smallest id stands for its class
        first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id"), F.col("row")))
        self.classes = stage(
            self.signed.groupBy("n", "key1", "key2").agg(first.getField("row").alias("class")), "minhash-classes"
        )
        members = self.signed.join(
            self.classes.where("n > 0").select("class"), F.col("row") == F.col("class"), "left_semi"
        )
        self.members = stage(members.withColumnRenamed("row", "class"), "minhash-members")

    def buckets(self) -> DataFrame:
        """``(class, n, low1, low2, band)`` of the buckets with several classes.

        Buckets of one class, which are the most, go before anything is joined.
        """
        rows = self.members.select("class", F.explode("bands").alias("band"))
        sizes = stage(rows.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "minhash-sizes")
        small = fits_in_memory(sizes)
        shared = stage(rows.join(F.broadcast(sizes) if small else sizes, "band"), "minhash-shared")
        # how many classes a class meets: the middle of a group of copies meets the most
        met = shared.groupBy("class").agg(F.sum("size").alias("met"))
        sketches = self.members.select("class", "n", "low1", "low2")
        return stage(shared.drop("size").join(met.join(sketches, "class"), "class"), "minhash-buckets")

    def plausible(self, a: str, b: str) -> Column:
        """The first step of the sequential test, on low bits, within the join."""
        bits = min(128, self.count)
        differ = sum(
            F.bit_count(F.col(f"{a}.low{i}").bitwiseXOR(F.col(f"{b}.low{i}"))) for i in (1, 2)
        )
        most = _most_differing_bits(bits, self.percent / 100, self._miss)
        return (differ <= most) & _similar_size(F.col(f"{a}.n"), F.col(f"{b}.n"), self.percent)

    def verify(self, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """The pairs ``(a, b)`` that are links: sequential test, then the whole sets."""
        minima = self.members.select("class", "minima")
        tested = _sequential_test(
            pairs.join(minima.select(F.col("class").alias("a"), F.col("minima").alias("minima_a")), "a").join(
                minima.select(F.col("class").alias("b"), F.col("minima").alias("minima_b")), "b"
            ),
            self.count,
            self.percent,
            self._miss,
        )
        tested = stage(tested, "minhash-tested")
        if sets is None:
            sets = self.sets(tested.select(F.explode(F.array("a", "b")).alias("class")).distinct())
        joined = tested.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("set_a")), "a").join(
            sets.select(F.col("class").alias("b"), F.col("shingles").alias("set_b")), "b"
        )
        common = F.size(F.array_intersect("set_a", "set_b"))
        linked = 100 * common >= self.percent * (F.size("set_a") + F.size("set_b") - common)
        return joined.where(linked).select("a", "b")

    def sets(self, classes: DataFrame) -> DataFrame:
        """``(class, shingles)`` of the classes, read from their first documents and written."""
        classes = stage(classes, "minhash-involved")
        named = self.members.join(classes, "class", "left_semi").select("class", "doc_id", "key1", "key2", "n")
        words = self._words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler = Shingler(words)
            for batch in steps(batches):
                sets = shingler(batch.column("text"))
                keys = [set_key(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([k[0] for k in keys], pa.int64()),
                        pa.array([k[1] for k in keys], pa.int64()),
                        pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["n", "key1", "key2", "shingles"],
                )

        named = stage(named, "minhash-named")
        read = restrict(self._docs, named).mapInArrow(run, "n long, key1 long, key2 long, shingles array<long>")
        # ids that repeat give some sets more than once
        keys = ["n", "key1", "key2"]
        found = read.join(named.drop("doc_id"), keys).select("class", "shingles").dropDuplicates(["class"])
        return stage(found, "minhash-sets")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    miss: float = MISS,
) -> DataFrame:
    """One row per row of ``docs``: ``row, doc_id, n_shingles, component_id, kept``.

    Documents are linked when ``100 * intersection >= percent * union`` of their sets of
    word shingles; ``component_id`` is the smallest id that can be reached. Texts without
    words, and null texts, are linked with nothing and kept. ``kept`` marks one row of each
    component: its smallest id, and of rows that repeat this id the first. Null ids come
    last; a component of null ids has a null ``component_id``.

    Equal sets are one class. The classes of a band's bucket are first compared with one
    class only, that which meets the most others in all its buckets. What then still lies
    in different components of a bucket is compared likewise under longer keys, and what
    is still apart is joined by rare shingles (:func:`_links_across`).
    So copies of one text never meet in pairs, and no link between classes of a bucket is
    lost. A pair passes a test on low bits of its minima and the sizes, then the sequential test
    on all minima, which prunes a pair at the threshold with probability ``miss`` per step;
    links are confirmed on the full sets.
    """
    small_batches(docs.sparkSession)
    found = _Classes(read_documents(docs, id_col, text_col), words, percent, bands, rows, miss)
    buckets = found.buckets()
    # the class that meets the most others is the one that links the most
    middle = F.max(F.struct("met", (-F.col("class")).alias("order"), "class", "n", "low1", "low2"))
    hubs = stage(
        buckets.groupBy("band").agg(middle.alias("hub")).select("band", "hub.class", "hub.n", "hub.low1", "hub.low2"),
        "minhash-hubs",
    ).alias("hub")
    stars = (
        buckets.alias("one")
        .join(
            hubs,
            (F.col("one.band") == F.col("hub.band"))
            & (F.col("one.class") != F.col("hub.class"))
            & found.plausible("one", "hub"),
        )
        .select(
            F.least("hub.class", "one.class").alias("a"), F.greatest("hub.class", "one.class").alias("b")
        )
        .distinct()
    )
    links = stage(found.verify(stage(stars, "minhash-stars")), "minhash-links")
    joined = stage(connected_components(links), "minhash-joined")
    classes = _mixed_classes(buckets, joined)
    if classes.head(1):
        sets = found.sets(classes.select("class"))
        for more in (_stars_of_long_keys, _links_across):
            known = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
            joined = stage(connected_components(known.union(more(found, classes, sets))), "minhash-joined")
            classes = _mixed_classes(buckets, joined) if more is _stars_of_long_keys else classes
    return _labelled(found, joined)


def _mixed_classes(buckets: DataFrame, joined: DataFrame) -> DataFrame:
    """``(class, n, component, outside)`` of all classes in buckets of several components.

    ``outside`` tells that a class lies outside the largest component of such a bucket. Of a
    pair of different components in one bucket at least one class does.
    """
    labels = joined.select(F.col("node").alias("class"), "component")
    labels = F.broadcast(labels) if fits_in_memory(labels) else labels
    placed = stage(
        buckets.select("class", "n", "band")
        .join(labels, "class", "left")
        .withColumn("component", F.coalesce("component", "class")),
        "minhash-placed",
    )
    sizes = placed.groupBy("band", "component").agg(F.count("*").alias("size"))
    mixed = stage(
        sizes.groupBy("band")
        .agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.count("*").alias("components"))
        .where("components > 1")
        .select("band", "main"),
        "minhash-mixed",
    )
    mixed = F.broadcast(mixed) if fits_in_memory(mixed) else mixed
    return stage(
        placed.join(mixed, "band")
        .groupBy("class", "n", "component")
        .agg(F.max(F.col("component") != F.col("main")).alias("outside")),
        "minhash-mixed-classes",
    )


def _stars_of_long_keys(found: _Classes, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the classes to one class of each of their buckets under ``KEYS`` long keys.

    A long key takes twice the rows of a band, from random places, so its buckets hold few
    but similar classes. The links join most of a group of edited copies, in a number of
    pairs that grows with the classes only.
    """
    width = 2 * ROWS
    random = np.random.Generator(np.random.PCG64(11))
    chosen = np.concatenate([random.choice(found.count, width, replace=False) for _ in range(KEYS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [
                _band_keys(np.frombuffer(m, np.uint32)[chosen], width) for m in batch.column("minima").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("class"), pa.array(keys, pa.list_(pa.int64()))], names=["class", "keys"]
            )

    members = found.members.join(classes.select("class", "component"), "class")
    keys = stage(members.select("class", "minima").mapInArrow(run, "class long, keys array<long>"), "minhash-long-keys")
    placed = keys.select("class", F.explode("keys").alias("band")).join(
        members.select("class", "component", "n", "low1", "low2"), "class"
    )
    placed = stage(placed, "minhash-long-buckets")
    middle = F.max(F.struct(F.xxhash64("class", "band"), "class", "component", "n", "low1", "low2"))
    hubs = stage(
        placed.groupBy("band").agg(middle.alias("hub"), F.count("*").alias("size")).where("size > 1").select(
            "band", "hub.class", "hub.component", "hub.n", "hub.low1", "hub.low2"
        ),
        "minhash-long-hubs",
    )
    pairs = placed.alias("one").join(
        hubs.alias("hub"),
        (F.col("one.band") == F.col("hub.band"))
        & (F.col("one.component") != F.col("hub.component"))
        & found.plausible("one", "hub"),
    ).select(F.least("hub.class", "one.class").alias("a"), F.greatest("hub.class", "one.class").alias("b"))
    return found.verify(stage(pairs.distinct(), "minhash-long-stars"), sets)


def _links_across(found: _Classes, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the classes of different components that share a bucket.

    The classes are joined by rare shingles: in any fixed order of the shingles, two sets
    that are similar enough share one among their first ``n - least + 1``, where ``least``
    is the fewest shingles that the smaller must share. The order goes by the number of
    sets that hold a shingle. So what many texts share, a passage or the common part of an
    edited text, comes last and makes few pairs.
    """
    tokens = sets.select("class", F.explode("shingles").alias("shingle"))
    shared = tokens.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1")
    known = stage(tokens.join(shared, "shingle"), "minhash-tokens")
    rest = F.col("n") - F.ceil(F.col("n") * found.percent / 100) + 1
    by_class, by_order = Window.partitionBy("class"), Window.partitionBy("class").orderBy("held", "shingle")
    # shingles of one set only come first in the order and match nothing
    alone = F.col("n") - F.count("*").over(by_class)
    first = stage(
        known.join(classes, "class")
        .withColumn("place", F.row_number().over(by_order) + alone)
        .where(F.col("place") <= rest)
        .join(found.members.select("class", "low1", "low2"), "class")
        .select("shingle", "class", "n", "component", "outside", "low1", "low2", (F.col("n") - F.col("place")).alias("after")),
        "minhash-first-tokens",
    )
    one, other = first.where("outside").alias("one"), first.alias("other")
    # at its first common shingle a pair can share that one and what comes after it in both
    most = F.least("one.after", "other.after") + 1
    enough = (100 + found.percent) * most >= found.percent * (F.col("one.n") + F.col("other.n"))
    # a pair of two outside classes is met from both sides, and taken once
    once = ~F.col("other.outside") | (F.col("one.class") < F.col("other.class"))
    pairs = one.join(
        other,
        (F.col("one.shingle") == F.col("other.shingle"))
        & (F.col("one.component") != F.col("other.component"))
        & once
        & enough
        & found.plausible("one", "other"),
    ).select(F.least("one.class", "other.class").alias("a"), F.greatest("one.class", "other.class").alias("b"))
    return found.verify(stage(pairs.distinct(), "minhash-across"), sets)


def _labelled(found: _Classes, joined: DataFrame) -> DataFrame:
    labels = found.classes.join(joined, F.col("class") == F.col("node"), "left").select(
        "n", "key1", "key2", F.when(F.col("n") > 0, F.coalesce("component", "class")).alias("component")
    )
    keys = ["n", "key1", "key2"]
    rows = found.signed.select("row", "doc_id", *keys).join(stage(labels, "minhash-labels"), keys)
    rows = stage(rows.select("row", "doc_id", F.col("n").alias("n_shingles"), "component"), "minhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id"), F.col("row")))
    firsts = stage(
        rows.where("component IS NOT NULL").groupBy("component").agg(first.alias("first")), "minhash-firsts"
    )
    return rows.join(firsts, "component", "left").select(
        "row",
        "doc_id",
        "n_shingles",
        F.when(F.col("first").isNotNull(), F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component; all columns pass unchanged.

    Rows that share an id stay or go together.
    """
    labelled = stage(near_duplicates(docs, id_col, text_col, **options), "minhash-decisions")
    kept = labelled.where("kept").select("doc_id")
    dropped = labelled.where("NOT kept").select("doc_id").subtract(kept)
    return restrict(docs, stage(dropped, "minhash-dropped"), "left_anti", id_col)
