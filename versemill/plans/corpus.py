"""Preparing texts for term statistics and topic models."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.functions import text, words
from versemill.operators import columns, lexicons, phrases, sampling

Preprocess = Callable[[Column], Column]


def corpus_steps() -> dict[str, Column]:
    """The row filters of the corpus, in order, for :func:`step_counts`."""
    return {
        "input": F.lit(True),
        "language": F.col("language") == "en",
        "genre": F.col("tag") == "rap",
        "year": columns.year_in_range(include_low=True),
        "lyrics": F.col("lyrics").isNotNull(),
        "artist": ~F.col("artist").startswith("Genius"),
    }


def filter_corpus(df: DataFrame) -> DataFrame:
    """English rap songs with plausible year, lyrics and artist, and their decade."""
    df = columns.filter_language(df, "en")
    df = columns.filter_genre(df, keep="rap")
    df = columns.filter_year_range(df, include_low=True)
    df = columns.drop_nulls(df, ["lyrics"])
    return columns.add_decade(columns.drop_artist_prefix(df))


def prepare_corpus(df: DataFrame, fraction: float = 0.05, seed: int = 42) -> DataFrame:
    """The filtered corpus, sampled repeatably, with cleaned lyrics."""
    sample = sampling.sample_fraction_hash(filter_corpus(df), fraction, seed)
    sample = sample.withColumn("artist", columns.strip_dollar(F.col("artist")))
    return columns.replace_column(sample, "lyrics", text.clean_text(F.col("lyrics")))


def pluggable_preprocess(df: DataFrame, preprocess: Preprocess, column: str = "lyrics", output: str = "tokens") -> DataFrame:
    """Apply a user's text-to-tokens function, given as Column function or Arrow UDF."""
    return df.withColumn(output, preprocess(F.col(column)))


def preprocess_default(
    df: DataFrame, lemmas: DataFrame, stop_words: Sequence[str] = words.default_words(), column: str = "lyrics"
) -> DataFrame:
    """Alphabetic tokens without stop words, then lemmas."""
    tokens = text.remove_stop_words(text.tokenize_alpha(F.col(column)), stop_words)
    return lexicons.lemmatize(df.withColumn("tokens", tokens), lemmas)


def preprocess_noun(
    df: DataFrame, tags: DataFrame, base: Sequence[str] = words.ENGLISH, column: str = "lyrics"
) -> DataFrame:
    """White-space tokens of three or more characters, without stop words, nouns only."""
    tokens = text.filter_token_length(text.tokenize_whitespace(F.col(column)), 3, drop_numeric=False)
    tokens = text.remove_stop_words(tokens, words.noun_words(base))
    return lexicons.keep_nouns(df.withColumn("tokens", tokens), tags)


def preprocess_v2(
    df: DataFrame, lemmas: DataFrame, base: Sequence[str] = words.ENGLISH, column: str = "lyrics"
) -> DataFrame:
    """Word tokens of three or more characters, lemmas, then stop words."""
    tokens = text.filter_token_length(text.tokenize_words(F.col(column)), 3)
    df = lexicons.lemmatize(df.withColumn("tokens", tokens), lemmas)
    return df.withColumn("tokens", text.remove_stop_words(F.col("tokens"), words.v2_words(base)))


def ngram_tokens(df: DataFrame, base: Sequence[str] = words.ENGLISH, column: str = "lyrics") -> DataFrame:
    """Simple tokens without stop words and recurrent terms."""
    return df.withColumn(
        "tokens", text.remove_stop_words(text.tokenize_simple(F.col(column)), words.ngram_words(base))
    )


def preprocess_ngram(
    df: DataFrame,
    bigrams: DataFrame,
    trigrams: DataFrame,
    lemmas: DataFrame,
    base: Sequence[str] = words.ENGLISH,
    column: str | None = "lyrics",
) -> DataFrame:
    """Tokens merged to learned phrases, then lemmas of the purely alphabetic ones.

    A merged phrase holds an underscore, so the last step drops it, as the original does.
    Without ``column``, ``df`` holds the tokens of :func:`ngram_tokens` that the phrases were
    learned from, so texts are not split a second time.
    """
    df = phrases.apply_phrases(df if column is None else ngram_tokens(df, base, column), bigrams)
    df = phrases.apply_phrases(df, trigrams)
    df = df.withColumn("tokens", text.keep_alpha(F.col("tokens")))
    return lexicons.lemmatize(df, lemmas)


def phrase_tokens(df: DataFrame, base: Sequence[str] = words.ENGLISH, column: str = "lyrics") -> DataFrame:
    """Symbol-free tokens with split contractions, without stop words."""
    tokens = text.tokenize_treebank(text.strip_singles_and_symbols(F.col(column)))
    return df.withColumn("tokens", text.remove_stop_words(tokens, words.phrase_words(base)))
