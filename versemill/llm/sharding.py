"""Shards of near equal size that keep equal texts together: balanced label propagation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versemill.llm.common import numbered, read_documents
from versemill.staging import stage

# Classes of priority in which moves are granted, and in which rows are numbered. Both
# bound what is summed per shard, whatever the number of documents.
_LOTS = 4096

ROUNDS = 8


def _lot(*of: Column | str) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(_LOTS)).cast("int")


def _granted(wishes: DataFrame, quota: np.ndarray) -> list[int]:
    """Per target shard the number of lots whose bytes fit its quota.

    ``wishes`` has ``target, lot, size``; at most shards x lots sums reach the driver.
    """
    sums = np.zeros((len(quota), _LOTS))
    for row in wishes.groupBy("target", "lot").agg(F.sum("size").alias("size")).collect():
        sums[row["target"], row["lot"]] = row["size"]
    fits = sums.cumsum(axis=1) <= np.maximum(quota, 0)[:, None]
    return np.where(fits.all(axis=1), _LOTS, fits.argmin(axis=1)).tolist()


def _at(values: list, index: Column, kind: str) -> Column:
    """The entry of a short list, one per shard."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), index + 1).cast(kind)


def _loads(placed: DataFrame, shards: int) -> np.ndarray:
    out = np.zeros(shards)
    for row in placed.groupBy("shard").agg(F.sum("size").alias("size")).collect():  # one row per shard
        out[row["shard"]] = row["size"]
    return out


def _split_giants(giants: list, capacity: float, shards: int) -> dict[tuple, list[tuple[float, int]]]:
    """Deal each group that nearly fills a shard to as few shards as hold it.

    Returns per group the shares (upper ends of parts of 1) and their shards. There are at
    most two such groups per shard.
    """
    free = np.full(shards, capacity)
    plan = {}
    for row in giants:
        left, parts = float(row["bytes"]), []
        while left > 0:
            shard = int(free.argmax())
            take = min(left, float(free[shard])) if free[shard] > 0 else left
            free[shard] -= take
            left -= take
            parts.append((1 - left / row["bytes"], shard))
        plan[(row["key"], row["size"])] = parts
    return plan


def _propagate(linked: DataFrame, capacity: float, other: np.ndarray, shards: int, rounds: int) -> DataFrame:
    """Move rows to the shard of most bytes of their group, round by round, within the capacities.

    ``other`` is what is placed already. In a round a group prefers the shard where most of
    it lies, or of the shards with room the one where most of it lies; moves are granted
    lot by lot, a lot holding whole groups, until the room of a shard is used.
    """
    for number in range(rounds):
        load = _loads(linked, shards) + other
        free = capacity - load
        roomy = [bool(f > 0) for f in free]
        over = [bool(f < 0) for f in free]
        rooms = [i for i, r in enumerate(roomy) if r]
        if not rooms:
            break
        weight = linked.groupBy("key", "size", "shard").agg(F.sum("size").alias("weight"))
        tie = F.xxhash64("key", "shard")
        choice = F.struct("weight", tie.alias("tie"), "shard")
        best = weight.groupBy("key", "size").agg(
            F.max(choice).alias("most"), F.max(F.when(_at(roomy, F.col("shard"), "boolean"), choice)).alias("open")
        )
        by_hash = _at(rooms, F.pmod(F.col("key"), F.lit(len(rooms))).cast("int"), "int")
        best = stage(
            best.select(
                "key",
                "size",
                F.col("most.shard").alias("most"),
                F.when(_at(roomy, F.col("most.shard"), "boolean"), F.col("most.shard"))
                .otherwise(F.coalesce(F.col("open.shard"), by_hash))
                .alias("target"),
            ),
            "shard-wishes",
        )
        wished = linked.join(best, ["key", "size"]).withColumn("lot", _lot("key", F.lit(number)))
        leaves = (F.col("shard") != F.col("most")) | _at(over, F.col("most"), "boolean")
        moves = leaves & (F.col("shard") != F.col("target"))
        wished = stage(wished.withColumn("moves", moves), "shard-moves")
        lots = _granted(wished.where("moves").select("target", "lot", "size"), free)
        granted = F.col("moves") & (F.col("lot") < _at(lots, F.col("target"), "int"))
        moved = wished.where(granted).limit(1).count()
        if not moved:
            break
        linked = stage(
            wished.select(
                "row", "key", "size", F.when(granted, F.col("target")).otherwise(F.col("shard")).alias("shard")
            ),
            "shard-labels",
        )
    return linked


def _fill(pool: DataFrame, capacity: float, load: np.ndarray) -> DataFrame:
    """Deal the rows of ``pool`` so that every shard takes its share of the free bytes.

    Large rows go first, so that smaller ones level what they leave uneven. Rows stand in
    the order of their lots; a row goes to the shard in whose part of the running sum its
    middle lies. Only sums per lot reach the driver.
    """
    limits = (capacity / 8, capacity / 64, capacity / 512)
    level = sum((F.col("size") < limit).cast("int") for limit in limits)
    pool = stage(pool.withColumn("level", level), "shard-pool")
    sums = np.zeros((len(limits) + 1, _LOTS))
    for row in pool.groupBy("level", "lot").agg(F.sum("size").alias("size")).collect():
        sums[row["level"], row["lot"]] = row["size"]
    filled = pool.select("row", F.lit(0).alias("shard")).limit(0)
    for number in range(len(sums)):
        total = float(sums[number].sum())
        if not total:
            continue
        # the levels before, this one and the later ones together fill all shards evenly
        room = np.maximum(capacity - load, 0)
        ends = np.cumsum(room) * (total / room.sum() if room.sum() else 0)
        before = np.concatenate([[0], np.cumsum(sums[number])[:-1]])
        starts = pool.sparkSession.createDataFrame(
            [(i, float(b)) for i, b in enumerate(before)], "lot int, before double"
        )
        earlier = Window.partitionBy("lot").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
        at = F.col("before") + F.coalesce(F.sum("size").over(earlier), F.lit(0)) + F.col("size") / 2
        bounds = F.array(*(F.lit(float(e)) for e in ends[:-1]))
        dealt = stage(
            pool.where(F.col("level") == number)
            .join(F.broadcast(starts), "lot")
            .withColumn("at", at)
            .withColumn("shard", F.size(F.filter(bounds, lambda e: e <= F.col("at"))))
            .select("row", "size", "shard"),
            "shard-dealt",
        )
        load = load + _loads(dealt, len(load))
        filled = filled.union(dealt.select("row", "shard"))
    return filled


def shard_documents(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the bytes of the text plus 16; shards get near equal sizes (law ``bytes``).
    Rows with equal texts are linked. Labels start from a hash of the row; groups that
    nearly fill a shard are first dealt to as few shards as hold them; all other linked
    rows move by balanced label propagation. Rows without equals come last and level the
    sizes to within about one document. Null texts count as empty and equal to empty ones;
    null and repeated ids are rows like others. ``slot`` numbers the rows of a shard from
    0. ``grown_shard`` is null under this law.
    """
    rows = numbered(
        read_documents(docs, id_col, text_col).select(
            "doc_id",
            (F.octet_length("text") + 16).cast("long").alias("size"),
            F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
            F.xxhash64("text", F.crc32(F.col("text").cast("binary"))).alias("key"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    capacity = -(-total // shards)
    groups = stage(
        rows.groupBy("key", "size").agg(F.count("*").alias("n")).where("n > 1").withColumn("bytes", F.col("n") * F.col("size")),
        "shard-groups",
    )
    linked = rows.join(groups, ["key", "size"]).select("row", "key", "size", "bytes")
    is_giant = F.col("bytes") >= capacity / 2
    plan = _split_giants(
        groups.where(is_giant).orderBy(F.desc("bytes"), "key", "size").collect(), capacity, shards
    )
    part = F.pmod(F.xxhash64("row"), F.lit(1 << 20)) / (1 << 20)
    giants = None
    if plan:
        parts = docs.sparkSession.createDataFrame(
            [(key, size, [(e, s) for e, s in found]) for (key, size), found in plan.items()],
            "key long, size long, parts array<struct<end: double, shard: int>>",
        )
        first = F.filter("parts", lambda p: p["end"] > part)
        last = F.element_at("parts", -1)["shard"]
        giants = stage(
            linked.where(is_giant)
            .join(F.broadcast(parts), ["key", "size"])  # at most two groups per shard
            .select("row", "size", F.coalesce(F.get(first, F.lit(0))["shard"], last).alias("shard")),
            "shard-giants",
        )
    start = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(shards)).cast("int")
    small = stage(linked.where(~is_giant).select("row", "key", "size", start.alias("shard")), "shard-start")
    fixed = _loads(giants, shards) if giants is not None else np.zeros(shards)
    small = _propagate(small, capacity, fixed, shards, rounds)
    # what a shard cannot hold goes back to be dealt with the rest
    wishes = small.withColumn("lot", _lot("key"))
    lots = _granted(wishes.select(F.col("shard").alias("target"), "lot", "size"), capacity - fixed)
    stays = F.col("lot") < _at(lots, F.col("shard"), "int")
    placed = wishes.where(stays).select("row", "size", "shard")
    if giants is not None:
        placed = placed.union(giants)
    placed = stage(placed, "shard-placed")
    pool = rows.join(placed.select("row"), "row", "left_anti").select("row", "size", _lot("row").alias("lot"))
    filled = _fill(pool, capacity, _loads(placed, shards))
    labels = stage(placed.select("row", "shard").union(filled), "shard-all")
    return _numbered_slots(rows.join(labels, "row"))


def _numbered_slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0, lot by lot."""
    rows = stage(rows.withColumn("lot", _lot("row")), "shard-rows-placed")
    lots = rows.groupBy("shard", "lot").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    lots = lots.select("shard", "lot", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "lot").orderBy(F.col("doc_id").asc_nulls_last(), "row")
    return rows.join(F.broadcast(lots), ["shard", "lot"]).select(  # shards x lots rows at most
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.row_number().over(inside) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
