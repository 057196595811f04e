"""C_V topic coherence (Röder, Both, Hinneburg 2015) over documents of any length.

A window of fixed size slides over each document. A word at position ``p`` lies in a known
interval of windows, so no window is materialised: the intervals of a topic's words are
swept per document, and the state of the sweep is a bit mask of the words currently in the
window. Window counts are summed per topic and mask, which is a small table, and all word
and pair counts follow from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versemill.operators.unnest import unnest_with_position
from versemill.staging import stage

# Parameters of the measure.
TOP_WORDS, WINDOW, EPSILON = 20, 110, 1e-12
# one bit per word of a topic
MAX_TOP_WORDS = 62


def window_masks(df: DataFrame, words: DataFrame, column: str, key: str, window: int) -> DataFrame:
    """``(topic, mask, windows)``: windows by the set of topic words they hold.

    ``df`` and ``words`` share the column ``_group``; texts are only searched for the words
    of their own group.
    """
    last_window = F.greatest(F.size(column) - window, F.lit(0))
    wanted = F.broadcast(words.select("_group", "term").distinct())
    found = (
        unnest_with_position(df, column, "_pos", "term", key, "_group", last_window.alias("_last"))
        .join(wanted, ["_group", "term"])
        .repartition(key)
        .select(
            key,
            "_group",
            "term",
            "_pos",
            F.greatest(F.col("_pos") - (window - 1), F.lit(0)).alias("_from"),
            F.least("_pos", "_last").alias("_to"),
        )
    )
    # starts and ends grow with the position, so cutting at the previous end suffices
    previous = F.lag("_to").over(Window.partitionBy(key, "term").orderBy("_pos"))
    intervals = found.withColumn("_from", F.greatest("_from", F.coalesce(previous + 1, F.lit(0)))).where("_from <= _to")
    events = intervals.join(F.broadcast(words), ["_group", "term"]).select(
        key,
        "topic",
        F.inline(
            F.array(
                F.struct(F.col("_from").alias("_at"), F.col("_bit").alias("_step")),
                F.struct((F.col("_to") + 1).alias("_at"), (-F.col("_bit")).alias("_step")),
            )
        ),
    )
    sweep = Window.partitionBy(key, "topic").orderBy("_at")
    return (
        events.select(
            "topic",
            F.sum("_step").over(sweep).alias("mask"),
            (F.lead("_at").over(sweep) - F.col("_at")).cast("long").alias("_length"),
        )
        .where((F.col("_length") > 0) & (F.col("mask") != 0))
        .groupBy("topic", "mask")
        .agg(F.sum("_length").alias("windows"))
    )


def topic_coherence(
    df: DataFrame,
    topic_terms: DataFrame,
    column: str = "tokens",
    key: str = "id",
    within: str | None = None,
    top_words: int = TOP_WORDS,
    window: int = WINDOW,
    epsilon: float = EPSILON,
) -> DataFrame:
    """``(topic, coherence)`` for ``topic_terms(topic, rank, term)``.

    ``topic`` may be any type, so the topics of several models can be scored in one pass.
    With ``within``, a column of both frames, a topic is scored on the texts of its own
    group only; topics must still be distinct over all groups.
    """
    if top_words > MAX_TOP_WORDS:
        raise ValueError(f"at most {MAX_TOP_WORDS} words per topic")
    group = (F.lit(0) if within is None else F.col(within)).alias("_group")
    texts = df.where(F.col(column).isNotNull()).select(key, column, group)
    in_topic = Window.partitionBy("topic").orderBy("rank")
    # top_words rows per topic, so the frames made from it may be broadcast
    words = stage(
        topic_terms.where(F.col("rank") <= top_words)
        .select(group, "topic", "term", (F.row_number().over(in_topic) - 1).alias("i"))
        .withColumn("_bit", F.expr("shiftleft(1L, i)")),
        "topic-words",
    )
    masks = stage(window_masks(texts, words, column, key, window), "window-masks")
    # a short text is one window
    in_text = F.greatest(F.size(column) - (window - 1), F.lit(1))
    totals = (
        texts.join(F.broadcast(words.select("_group").distinct()), "_group", "left_semi")
        .groupBy("_group")
        .agg(F.sum(in_text).cast("double").alias("total"))
    )

    def bit(i: int) -> Column:
        return F.shiftright("mask", i).bitwiseAND(F.lit(1)) == 1

    counts = [F.coalesce(F.sum(F.when(bit(i), F.col("windows"))), F.lit(0)).alias(f"_{i}") for i in range(top_words)]
    as_array = F.array(*[F.col(f"_{i}") for i in range(top_words)])
    # windows with word j per topic, and with words i and j per topic and i
    alone = masks.groupBy("topic").agg(*counts).select("topic", as_array.alias("n"))
    members = F.array_compact(F.array(*[F.when(bit(i), F.lit(i)) for i in range(top_words)]))
    together = (
        masks.withColumn("i", F.explode(members)).groupBy("topic", "i").agg(*counts).select("topic", "i", as_array.alias("n_i"))
    )
    sizes = words.groupBy("topic").agg(F.count("*").alias("size"))
    rows = (
        words.select("_group", "topic", "i")
        .join(F.broadcast(totals), "_group")
        .join(F.broadcast(sizes), "topic")
        .join(F.broadcast(alone), "topic", "left")
        .join(F.broadcast(together), ["topic", "i"], "left")
    )

    def npmi(j: Column) -> Column:
        p_ij = F.coalesce(F.col("n_i")[j], F.lit(0)) / F.col("total")
        p_i, p_j = F.col("n")[F.col("i")] / F.col("total"), F.col("n")[j] / F.col("total")
        value = F.ln((p_ij + epsilon) / (p_i * p_j)) / -F.ln(p_ij + epsilon)
        return F.when((p_i > 0) & (p_j > 0), value).otherwise(F.lit(0.0))

    positions = F.sequence(F.lit(0), F.col("size") - 1)
    vectors = rows.select("topic", "i", "size", F.transform(positions, lambda j: npmi(j.cast("int"))).alias("v"))
    sums = (
        vectors.select("topic", F.posexplode("v").alias("j", "x"))
        .groupBy("topic", "j")
        .agg(F.sum("x").alias("x"))
        .groupBy("topic")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("s"))
    )

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)

    norms = F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("s"), F.col("s")))
    cosine = F.when(norms > 0, dot(F.col("v"), F.col("s")) / norms).otherwise(F.lit(0.0))
    return (
        vectors.join(F.broadcast(sums), "topic")
        .select("topic", cosine.alias("c"))
        .groupBy("topic")
        .agg(F.avg("c").alias("coherence"))
    )


def coherence_cv(df: DataFrame, topic_terms: DataFrame, **settings) -> DataFrame:
    """``(coherence)``: the mean over the topics."""
    return topic_coherence(df, topic_terms, **settings).agg(F.avg("coherence").alias("coherence"))
