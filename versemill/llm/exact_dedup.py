"""Exact duplicates by progressive refinement: length, then hash of the prefix, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.joins import fits_in_memory
from versemill.llm.common import numbered, read_documents, same_id
from versemill.staging import stage

# Matches what the normalisation changes: a single plain space stays as it is.
_SPACES = r"[\t-\r][ \t-\r]*| [ \t-\r]+"

# Characters that the second level hashes.
PREFIX = 256

# Bits of the filter for surviving groups: 2 MB whatever the data. A fuller filter lets more
# documents through to the full hash; it never changes the result.
FILTER_BITS = 1 << 24
_BITS_PER_MAP = 32768


def normalise(text: Column) -> Column:
    """Replace every run of ASCII white space by one space."""
    return F.regexp_replace(text, _SPACES, " ")


def _surviving(levels: DataFrame, bits: int) -> DataFrame:
    """A bitmap, in pieces of 4 KB, of the (length, prefix) groups with several rows."""
    groups = stage(levels.groupBy("n", "prefix").agg(F.count("*").alias("rows")), "exact-prefix")
    lengths = groups.groupBy("n").agg(F.sum("rows").alias("of_length")).where("of_length > 1").select("n")
    slot = F.pmod(F.xxhash64("n", "prefix"), F.lit(bits))
    return (
        groups.join(lengths, "n", "left_semi")
        .where("rows > 1")
        .select(slot.alias("slot"))
        .groupBy(F.expr(f"slot div {_BITS_PER_MAP}").alias("piece"))
        .agg(F.bitmap_construct_agg(F.expr(f"slot % {_BITS_PER_MAP}")).alias("bits"))
    )


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digests: bool = False,
    prefix: int = PREFIX,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """One row per row of ``docs``: ``row, doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after :func:`normalise`; null counts as empty.
    Of equal texts the row with the smallest id stays; a null id comes last, and of rows
    that repeat an id one stays. The first pass takes length and prefix hash of each text;
    groups are refined by length, then by prefix. The second pass hashes a full text only
    if its (length, prefix) group has several rows, so ``text_sha256`` is null for the
    others, unless ``digests`` asks for every digest. Texts are never shuffled. An empty
    table gives an empty result.
    """
    rows = read_documents(docs, id_col, text_col).withColumn("text", normalise(F.col("text")))
    levels = rows.select(
        "doc_id", "text", F.length("text").alias("n"), F.xxhash64(F.substring("text", 1, prefix)).alias("prefix")
    )
    filter_pieces = stage(_surviving(levels.drop("doc_id", "text"), filter_bits), "exact-filter")
    slot = F.pmod(F.xxhash64("n", "prefix"), F.lit(filter_bits))
    byte = F.conv(F.hex(F.substring("bits", (F.col("slot") % _BITS_PER_MAP / 8).cast("int") + 1, F.lit(1))), 16, 10)
    survives = F.coalesce(
        F.call_function("getbit", byte.cast("int"), (F.col("slot") % 8).cast("int")) == 1, F.lit(False)
    )
    full = F.unhex(F.sha2("text", 256))
    hashed = numbered(
        levels.withColumn("slot", slot)
        .withColumn("piece", F.expr(f"slot div {_BITS_PER_MAP}"))
        .join(F.broadcast(filter_pieces), "piece", "left")  # filter_bits / 8 bytes at most
        .withColumn("survives", survives)
        .select("doc_id", "survives", (full if digests else F.when(F.col("survives"), full)).alias("sha")),
        "exact-hashed",
    )
    candidates = hashed.where("survives")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id"), F.col("row")))
    groups = stage(
        candidates.groupBy("sha").agg(first.alias("first"), F.count("*").alias("group_size")).where("group_size > 1"),
        "exact-groups",
    )
    joined = candidates.join(groups, "sha", "left")
    alone = hashed.where("NOT survives").select("*", F.lit(None).alias("first"), F.lit(None).alias("group_size"))
    return joined.select(*alone.columns).union(alone).select(
        "row",
        "doc_id",
        F.when(F.col("first").isNotNull(), F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text an earlier document has.

    All columns pass unchanged. A row is known by its id and its text; of repeated rows
    with equal id and text one stays.
    """
    groups = stage(exact_groups(docs, id_col, text_col).where("group_size > 1"), "exact-decisions")
    decided = stage(
        groups.groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).agg(
            F.max("kept").alias("_kept"), (F.count("*") > 1).alias("_repeats")
        ).where("NOT _kept OR _repeats"),
        "exact-dropped",
    )
    text = normalise(F.coalesce(docs[text_col], F.lit("")))
    hashed = docs.withColumn("_text_sha", F.sha2(text, 256))

    def matching(keys: DataFrame, how: str) -> DataFrame:
        keys = F.broadcast(keys) if fits_in_memory(keys) else keys
        condition = same_id(hashed[id_col].cast("long"), keys["_id"]) & (hashed["_text_sha"] == keys["_sha"])
        return hashed.join(keys, condition, how)

    kept = matching(decided, "left_anti")
    repeats = decided.where("_kept AND _repeats")
    if repeats.head(1):
        kept = kept.union(matching(repeats, "left_semi").dropDuplicates([id_col, "_text_sha"]))
    return kept.drop("_text_sha")
