"""Tables behind a topic dashboard: shares, relevant terms, distances, projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versemill.operators import topic_matrix
from versemill.operators.topic_bound import token_count
from versemill.operators.topics import TopicModel, dominant_topic, term_probabilities, topic_distribution
from versemill.staging import stage

RELEVANT_TERMS = 30


def weighted_share(weights: DataFrame, theta: str = "theta", length: str = "length") -> DataFrame:
    """``(topic, share)`` of rows with an array of topic weights and a length."""
    weighted = (
        weights.select(F.col(length).alias("_length"), F.posexplode(theta).alias("topic", "weight"))
        .groupBy("topic")
        .agg(F.sum(F.col("weight") * F.col("_length")).alias("_mass"))
    )
    total = weighted.agg(F.sum("_mass")).scalar()
    return weighted.select("topic", (F.col("_mass") / total).alias("share"))


def topic_share(fitted: TopicModel, documents: DataFrame) -> DataFrame:
    """``(topic, share)``: topic sizes weighted by document length in counted tokens."""
    return weighted_share(topic_distribution(fitted, documents).withColumn("length", token_count()))


def topic_blocks(fitted: TopicModel) -> DataFrame:
    """The term probabilities of all topics as a written table of blocks."""
    spark = SparkSession.active()
    return topic_matrix.write_blocks(spark, term_probabilities(fitted), fitted.terms)


def topic_term_probabilities(fitted: TopicModel) -> DataFrame:
    """``(topic, term, p)``: the whole topic-term matrix in long form."""
    return topic_matrix.long_form(topic_blocks(fitted), fitted.k)


def topic_term_relevance(
    fitted: TopicModel,
    documents: DataFrame,
    n_terms: int = RELEVANT_TERMS,
    weight: float = 0.6,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """``(topic, rank, term, relevance)``: terms by log probability and log lift."""
    shares = [0.0] * fitted.k
    for row in topic_share(fitted, documents).collect():  # one row per topic
        shares[row.topic] = row.share
    return topic_matrix.relevant_terms(topic_blocks(fitted) if blocks is None else blocks, shares, n_terms, weight)


def topic_distance(probabilities: DataFrame, k: int) -> DataFrame:
    """``(topic_a, topic_b, distance)``: Jensen–Shannon distance of topic pairs, a < b.

    ``probabilities`` are blocks, which need no shuffle, or a long table ``(topic, term, p)``.
    """
    blocks = probabilities if "weights" in probabilities.columns else topic_matrix.blocks_of(probabilities, k)
    return topic_matrix.jensen_shannon(blocks, k)


def topic_covariance(weights: DataFrame, k: int, theta: str = "theta") -> DataFrame:
    """``(i, j, covariance)`` of all pairs of topics, i <= j, in one pass.

    A task sums weights and their products over its rows; only these ``k * (k + 3) / 2``
    numbers are shuffled. The divisor is the number of rows less one.
    """
    first, second = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, products = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            count, sums, products = count + len(x), sums + x.sum(axis=0), products + x.T @ x
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(first.astype(np.int32)),
                pa.array(second.astype(np.int32)),
                pa.array(np.full(len(first), count)),
                pa.array(sums[first]),
                pa.array(sums[second]),
                pa.array(products[first, second]),
            ],
            names=["i", "j", "n", "si", "sj", "p"],
        )

    parts = weights.select(theta).mapInArrow(run, "i int, j int, n long, si double, sj double, p double")
    n, si, sj, p = (F.sum(c) for c in ("n", "si", "sj", "p"))
    covariance = (p - si * sj / n) / F.nullif(n - 1, F.lit(0))
    return parts.groupBy("i", "j").agg(covariance.alias("covariance"))


def principal_axes(covariance: DataFrame, k: int, dimensions: int) -> np.ndarray:
    """Directions of the greatest variance, k x dimensions; the largest part of each is positive."""
    matrix = np.zeros((k, k))
    for row in covariance.collect():  # k * (k + 1) / 2 rows
        matrix[row.i, row.j] = matrix[row.j, row.i] = row.covariance or 0.0
    axes = np.linalg.eigh(matrix)[1][:, ::-1][:, :dimensions]
    return axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])


def project_doc_topics(fitted: TopicModel, documents: DataFrame, dimensions: int = 2, key: str = "id") -> DataFrame:
    """``(id, topic, x, y[, z])``: principal components of the topic weights.

    The topics of the documents are inferred once and written; the components come from a
    k x k problem. A model of fewer topics than dimensions has zeros for the others.
    """
    if dimensions not in (2, 3):
        raise ValueError(f"2 or 3 dimensions, not {dimensions}")
    weights = stage(topic_distribution(fitted, documents).select(key, "theta"), "doc-topics")
    axes = principal_axes(topic_covariance(weights, fitted.k), fitted.k, dimensions)

    def along(axis: int) -> Column:
        if axis >= axes.shape[1]:
            return F.lit(0.0)
        return sum((F.col("theta")[i] * F.lit(float(axes[i, axis])) for i in range(fitted.k)), F.lit(0.0))

    return weights.select(key, dominant_topic("theta").alias("topic"), *[along(i).alias("xyz"[i]) for i in range(dimensions)])
