"""Collocations: scored pairs and triples of neighbouring tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from versemill.functions.gram_counts import by_steps, count_grams, found_phrases, gram_filter
from versemill.joins import fits_in_memory, join_lookup
from versemill.staging import stage

# Settings of the collocation filters.
MIN_COUNT, MIN_PMI, TOP = 50, 5.0, 500
REMNANTS = ("n", "t", "PRON")


def gram_counts(
    df: DataFrame, longest: int, min_count: int, column: str = "tokens", staged: bool = False
) -> list[DataFrame]:
    """Written tables of the words ``(w1, n)``, pairs ``(w1, w2, n)`` and so on up to ``longest``.

    Words are kept all, n-grams from ``min_count`` on. An n-gram is at most as frequent as
    its parts, so each length is counted in a pass that only looks at n-grams whose two
    parts are frequent; what is rare never reaches a shuffle. The lists are written first
    unless ``df`` is a written table.
    """
    lists = df.select(column)
    if longest > 1 and not staged:
        lists = stage(lists, "token-lists")
    tables = [stage(count_grams(lists, 1), "gram-counts")]
    for n in range(2, longest + 1):
        frequent = None
        if min_count > 1:
            words = [f"w{i}" for i in range(1, n)]
            bitmap = gram_filter(tables[-1].where(F.col("n") >= min_count), words)
            frequent = df.sparkSession.sparkContext.broadcast(bitmap)
        tables.append(stage(count_grams(lists, n, frequent).where(F.col("n") >= min_count), "gram-counts"))
    return tables


def with_word_counts(grams: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """Append the count of each part as ``n1 … nn``; ``counts`` is a written table."""
    words = [f"w{i}" for i in range(1, n + 1)]
    for i, word in enumerate(words, 1):
        part = counts.select(F.col("word").alias(word), F.col("n").alias(f"n{i}"))
        grams = join_lookup(grams, part, [word], spread_by=words, staged=True)
    return grams


def _scored(tables: list[DataFrame], n: int, min_count: int) -> DataFrame:
    counts = tables[0].withColumnRenamed("w1", "word")
    total = counts.agg(F.sum("n")).scalar().cast("double")
    # a part of a frequent n-gram is itself as frequent
    scored = with_word_counts(tables[n - 1], counts.where(F.col("n") >= min_count), n)
    parts = reduce(lambda a, b: a * b, [F.col(f"n{i}").cast("double") for i in range(1, n + 1)])
    together = F.col("n").cast("double") * reduce(lambda a, b: a * b, [total] * (n - 1))
    return scored.select(*[f"w{i}" for i in range(1, n + 1)], "n", F.log2(together / parts).alias("pmi"))


def bigram_pmi(df: DataFrame, min_count: int = MIN_COUNT, column: str = "tokens") -> DataFrame:
    """``(w1, w2, n, pmi)`` of pairs seen at least ``min_count`` times."""
    return _scored(gram_counts(df, 2, min_count, column), 2, min_count)


def trigram_pmi(df: DataFrame, min_count: int = MIN_COUNT, column: str = "tokens") -> DataFrame:
    """``(w1, w2, w3, n, pmi)`` of triples seen at least ``min_count`` times."""
    return _scored(gram_counts(df, 3, min_count, column), 3, min_count)


def collocations(
    df: DataFrame, min_count: int = MIN_COUNT, column: str = "tokens"
) -> tuple[DataFrame, DataFrame]:
    """The tables of :func:`bigram_pmi` and :func:`trigram_pmi` from the same counts."""
    tables = gram_counts(df, 3, min_count, column)
    return _scored(tables, 2, min_count), _scored(tables, 3, min_count)


def _filter_ngrams(
    grams: DataFrame,
    lexicon: DataFrame,
    stop_words: Sequence[str],
    n: int,
    tags_fit: Column,
    lengths_fit: Column,
    min_pmi: float,
    top: int,
) -> DataFrame:
    words = [f"w{i}" for i in range(1, n + 1)]
    barred = sorted({*stop_words, *REMNANTS})
    grams = grams.where((F.col("pmi") > min_pmi) & ~reduce(lambda a, b: a | b, [F.col(w).isin(barred) for w in words]))
    # only the tags of words in question, a pair or triple of frequent ones, are looked up
    grams = stage(grams, "scored-grams")
    needed = stage(grams.select(F.explode(F.array(*words[:2])).alias("word")).distinct(), "gram-words")
    listed = lexicon.join(F.broadcast(needed) if fits_in_memory(needed) else needed, "word", "left_semi")
    tags = stage(listed.groupBy("word").agg(F.min("tag").alias("tag")), "tags")
    for i, word in enumerate(words[:2], 1):
        part = tags.select(F.col("word").alias(word), F.col("tag").alias(f"t{i}"))
        grams = join_lookup(grams, part, [word], spread_by=words, how="left", staged=True)
    # an unknown word counts as a noun
    grams = grams.fillna("NN", ["t1", "t2"])
    return (
        grams.where(tags_fit)
        .orderBy(F.desc("pmi"), *words)
        .limit(top)
        .where(lengths_fit)
        .select(F.concat_ws(" ", *words).alias("phrase"), *words, "n", "pmi")
    )


def filter_bigrams(
    grams: DataFrame,
    lexicon: DataFrame,
    stop_words: Sequence[str],
    min_pmi: float = MIN_PMI,
    top: int = TOP,
) -> DataFrame:
    """The ``top`` noun-like pairs by score; the length test comes after the cut."""
    tags_fit = F.col("t1").isin("JJ", "NN") | (F.col("t2") == "NN")
    lengths_fit = (F.char_length("w1") > 2) | (F.char_length("w2") > 2)
    return _filter_ngrams(grams, lexicon, stop_words, 2, tags_fit, lengths_fit, min_pmi, top)


def filter_trigrams(
    grams: DataFrame,
    lexicon: DataFrame,
    stop_words: Sequence[str],
    min_pmi: float = MIN_PMI,
    top: int = TOP,
) -> DataFrame:
    """The ``top`` noun-like triples by score; the third word's tag is not tested."""
    tags_fit = F.col("t1").isin("JJ", "NN") | F.col("t2").isin("JJ", "NN")
    lengths_fit = (F.char_length("w1") > 2) | ((F.char_length("w2") > 2) & (F.char_length("w3") > 2))
    return _filter_ngrams(grams, lexicon, stop_words, 3, tags_fit, lengths_fit, min_pmi, top)


def ranked_phrases(trigrams: DataFrame, bigrams: DataFrame) -> list[str]:
    """Filtered triples, then pairs, each in rank order. Both tables are cut to ``top`` rows."""
    ranked = [F.desc("pmi"), "phrase"]
    return [row.phrase for part in (trigrams, bigrams) for row in part.orderBy(*ranked).collect()]


def join_ngrams_batch(texts: pa.Array, phrases: Sequence[str], find: Callable[[str], list[int]]) -> pa.Array:
    """Join the phrases that ``find`` tells of, in the order of their places."""
    out = []
    for text in texts.to_pylist():
        if text is not None:
            for place in find(text):
                text = text.replace(phrases[place], phrases[place].replace(" ", "_"))
        out.append(text)
    return pa.array(out, pa.string())


def join_ngrams_in_text(text: Column, phrases: Sequence[str]) -> Column:
    """Join each phrase by underscores wherever it occurs, one after the other.

    Later phrases see the text as the earlier ones left it. An automaton of all phrases
    reads a text once; a phrase that does not occur costs nothing.
    """
    phrases = [p for p in phrases if p]
    if not phrases:
        return text

    @F.arrow_udf(StringType())
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = found_phrases(phrases)
        for texts in batches:
            yield by_steps(texts, lambda part: join_ngrams_batch(part, phrases, find))

    return apply(text)
