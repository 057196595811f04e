"""Vocabulary, bag of words and term statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from versemill.functions.gram_counts import count_terms, row_counts
from versemill.joins import join_lookup
from versemill.operators.columns import filter_decades
from versemill.operators.unnest import unnest, unnest_structs
from versemill.staging import stage, with_row_index

# Vocabulary limits of the second topic pipeline.
NO_BELOW, NO_ABOVE, KEEP_N = 100, 0.8, 100_000

# A topic model holds one weight per topic and term on the driver.
MAX_MODEL_TERMS = 2_000_000


def term_frequencies(df: DataFrame, column: str = "tokens") -> DataFrame:
    """``(term, doc_freq, term_freq)``; a document is one row, so no shuffle by document is needed."""
    return count_terms(df.select(column))


def build_vocabulary(df: DataFrame, column: str = "tokens") -> DataFrame:
    """``(term_id, term, doc_freq, term_freq)``; ids follow the order of the terms."""
    return with_row_index(term_frequencies(df, column), "term", name="term_id").select(
        "term_id", "term", "doc_freq", "term_freq"
    )


def filter_vocabulary(
    vocabulary: DataFrame,
    n_docs: int,
    no_below: int = NO_BELOW,
    no_above: float = NO_ABOVE,
    keep_n: int | None = KEEP_N,
) -> DataFrame:
    """Keep terms that are neither rare nor in most documents, the most frequent ``keep_n``.

    Ids are given anew. Frequency ties at the cut are resolved by term.
    """
    kept = vocabulary.where((F.col("doc_freq") >= no_below) & (F.col("doc_freq") <= F.lit(no_above * n_docs)))
    if keep_n is not None and kept.count() > keep_n:
        # the cut is found on the counts per frequency, not by sorting all terms
        downwards = Window.orderBy(F.desc("doc_freq")).rowsBetween(Window.unboundedPreceding, -1)
        cut = (
            kept.groupBy("doc_freq")
            .agg(F.count("*").alias("n"))
            .withColumn("above", F.coalesce(F.sum("n").over(downwards), F.lit(0)))
            .where((F.col("above") < keep_n) & (F.col("above") + F.col("n") >= keep_n))
            .first()
        )
        ties = kept.where(F.col("doc_freq") == cut.doc_freq).orderBy("term").limit(keep_n - cut.above)
        kept = kept.where(F.col("doc_freq") > cut.doc_freq).unionByName(ties)
    return with_row_index(kept.drop("term_id"), "term", name="term_id").select(
        "term_id", "term", "doc_freq", "term_freq"
    )


def group_vocabularies(
    df: DataFrame,
    group: str,
    no_below: int = NO_BELOW,
    no_above: float = NO_ABOVE,
    keep_n: int = KEEP_N,
    column: str = "tokens",
    max_terms: int = MAX_MODEL_TERMS,
) -> dict[object, tuple[list[str], int]]:
    """The filtered vocabulary of each value of ``group``, in order, and its number of documents.

    All groups are counted in one pass. The rules are those of :func:`filter_vocabulary`,
    each group by its own documents; at most ``keep_n`` terms of a group reach the driver.
    """
    counts = (
        _term_counts(df, column, group)
        .groupBy(group, "term")
        .agg(F.count("*").alias("doc_freq"))
        .where(F.col("doc_freq") >= no_below)
    )
    # one row per group
    sizes = {row[0]: row[1] for row in df.groupBy(group).agg(F.count("*")).collect()}
    limits = df.sparkSession.createDataFrame(
        [(g, float(no_above * n)) for g, n in sizes.items()], StructType([df.schema[group], StructField("_most", DoubleType())])
    )
    ranked = Window.partitionBy(group).orderBy(F.desc("doc_freq"), "term")
    kept = (
        counts.join(F.broadcast(limits), group)
        .where(F.col("doc_freq") <= F.col("_most"))
        .withColumn("_rank", F.row_number().over(ranked))
        .where(F.col("_rank") <= keep_n)
        .select(group, "term")
    )
    kept = stage(kept, "group-vocabularies")
    size = kept.count()
    if size > max_terms:
        raise ValueError(f"{size} terms of all groups exceed {max_terms}; choose a smaller keep_n")
    terms: dict[object, list[str]] = {g: [] for g in sizes}
    for row in kept.toLocalIterator():
        terms[row[0]].append(row.term)
    return {g: (sorted(terms[g]), n) for g, n in sizes.items()}


def bag_of_words(df: DataFrame, vocabulary: DataFrame, column: str = "tokens", key: str = "id") -> DataFrame:
    """``(id, term_id, term, tf)``; tokens outside the vocabulary are ignored.

    A document is one row; rows that repeat an id are counted apart.
    """
    counts = _term_counts(df, column, key).withColumnRenamed("n", "tf")
    return join_lookup(counts, vocabulary.select("term", "term_id"), ["term"], spread_by=[key, "term"]).select(
        key, "term_id", "term", "tf"
    )


def _term_counts(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """``keep`` columns, ``term`` and ``n``; a document is one row, so it is counted where it lies."""
    return unnest_structs(df, row_counts(F.col(column)), ["term", "n"], *keep)


def vocabulary_terms(vocabulary: DataFrame, max_terms: int = MAX_MODEL_TERMS) -> list[str]:
    """The terms in id order, for a model; larger vocabularies must be filtered first."""
    size = vocabulary.count()
    if size > max_terms:
        raise ValueError(f"{size} terms exceed the {max_terms} a model can hold; use filter_vocabulary")
    return [row.term for row in vocabulary.orderBy("term_id").select("term").collect()]


def vectorize(df: DataFrame, terms: Sequence[str], column: str = "tokens", output: str = "features") -> DataFrame:
    """Append term-count vectors."""
    spark, joined = df.sparkSession, "\n".join(terms)
    if joined.count("\n") == len(terms) - 1 and all(terms):
        # a vocabulary sent as one text: from_vocabulary makes a call per term
        strings = spark._jvm.java.util.regex.Pattern.compile("\n").split(joined)
        model = CountVectorizerModel._create_from_java_class(
            "org.apache.spark.ml.feature.CountVectorizerModel", strings
        )
        model._set(inputCol=column, outputCol=output)
    else:
        model = CountVectorizerModel.from_vocabulary(list(terms), inputCol=column, outputCol=output)
    return model.transform(df)


def term_document_matrix(df: DataFrame, decades: Sequence[int], column: str = "tokens", key: str = "id") -> DataFrame:
    """``(id, decade, term, n)`` for songs of the listed decades."""
    return _term_counts(filter_decades(df, decades), column, key, "decade")


def term_document_matrix_decade(
    df: DataFrame, decades: Sequence[int], decade: int, column: str = "tokens", key: str = "id"
) -> DataFrame:
    """The same for one of the listed decades."""
    if decade not in decades:
        raise ValueError(f"{decade} is not among the decades {list(decades)}")
    return term_document_matrix(df, [decade], column, key)


def top_terms_by_decade(df: DataFrame, n_terms: int = 10, column: str = "tokens") -> DataFrame:
    """``(decade, rank, term, n)``: the most frequent terms of each decade, ties by term."""
    counts = (
        unnest(df, column, "term", "decade")
        .groupBy("decade", "term")
        .agg(F.count("*").alias("n"))
    )
    ranked = Window.partitionBy("decade").orderBy(F.desc("n"), "term")
    return (
        counts.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= n_terms)
        .select("decade", "rank", "term", "n")
    )
