"""The topic-term matrix of a model as a written table of blocks.

A block is a row with consecutive terms and their numbers, ``k`` per term. The model keeps
its matrix on the driver; it is written slab by slab, so a plan holds one bounded slab at
most, and readers find a plain table whose blocks are spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versemill.staging import new_path

BLOCK_TERMS = 1024

# Numbers of a slab, which one write sends to the cluster.
SLAB = 1 << 20

BLOCKS = "block long, terms array<string>, weights array<double>"


def write_blocks(
    spark: SparkSession, matrix: np.ndarray, terms: Sequence[str] | None = None, block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """``(block, terms, weights)`` of a matrix of terms x k; block ``b`` begins with term ``b * block_terms``."""
    path, k = new_path(spark, "topic-blocks"), matrix.shape[1]
    step = block_terms * max(1, SLAB // (block_terms * k))
    for start in range(0, len(matrix), step):
        firsts = range(start, min(start + step, len(matrix)), block_terms)
        slab = pa.table(
            {
                "block": pa.array([f // block_terms for f in firsts], pa.int64()),
                "terms": pa.array(
                    [None if terms is None else list(terms[f : f + block_terms]) for f in firsts], pa.list_(pa.string())
                ),
                "weights": pa.array([matrix[f : f + block_terms].ravel() for f in firsts], pa.list_(pa.float64())),
            }
        )
        spark.createDataFrame(slab, BLOCKS).write.mode("append").parquet(path)
    return spark.read.schema(BLOCKS).parquet(path)


def blocks_of(probabilities: DataFrame, k: int) -> DataFrame:
    """The form of blocks, a term each, of a long table ``(topic, term, p)``; what is missing is 0."""
    of_topic = [F.coalesce(F.sum(F.when(F.col("topic") == t, F.col("p"))), F.lit(0.0)) for t in range(k)]
    return probabilities.groupBy("term").agg(F.array(*of_topic).alias("weights")).select(
        F.lit(None).cast("long").alias("block"), F.array("term").alias("terms"), "weights"
    )


def long_form(blocks: DataFrame, k: int) -> DataFrame:
    """``(topic, term, p)`` of all blocks."""
    places = F.sequence(F.lit(0), F.lit(k - 1))
    cell = F.col("weights")[F.col("_at") * k + F.col("topic")]
    return (
        blocks.select(F.posexplode("terms").alias("_at", "term"), "weights")
        .select("_at", "term", "weights", F.explode(places).alias("topic"))
        .select("topic", "term", cell.alias("p"))
    )


def _numbers(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column("weights").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def best_per_topic(terms: list[str], scores: np.ndarray, n: int) -> Iterator[tuple[int, str, float]]:
    """The ``n`` best terms of each column, ties by term; scores that are no numbers are left out."""
    for topic, column in enumerate(scores.T):
        at = np.flatnonzero(~np.isnan(column))
        if len(at) > n:
            least = np.partition(column[at], len(at) - n)[len(at) - n]
            at = at[column[at] >= least]  # all ties of the last one
        for i in sorted(at.tolist(), key=lambda i: (-column[i], terms[i]))[:n]:
            yield topic, terms[i], float(column[i])


def relevant_terms(blocks: DataFrame, shares: Sequence[float], n_terms: int, weight: float) -> DataFrame:
    """``(topic, rank, term, relevance)``: the best terms of each topic.

    Relevance is ``weight * ln(p) + (1 - weight) * ln(p / p_term)``, where a term's own
    probability is the sum over topics of share and probability. Every batch of blocks
    hands on the best of each topic only. A term of probability 0 is never relevant.
    """
    shares, k = np.asarray(shares, float), len(shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _numbers(batch, k)
            with np.errstate(divide="ignore", invalid="ignore"):
                # summed row by row, so that equal terms score alike wherever they lie
                scores = weight * np.log(p) + (1 - weight) * np.log(p / (p * shares).sum(axis=1, keepdims=True))
            scores[p <= 0] = np.nan
            found = list(zip(*best_per_topic(batch.column("terms").flatten().to_pylist(), scores, n_terms)))
            columns = found or [[], [], []]
            kinds = [pa.int32(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["topic", "term", "relevance"]
            )

    ranked = Window.partitionBy("topic").orderBy(F.desc("relevance"), "term")
    return (
        blocks.select("terms", "weights")
        .mapInArrow(run, "topic int, term string, relevance double")
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= n_terms)
        .select("topic", "rank", "term", "relevance")
    )


def jensen_shannon(blocks: DataFrame, k: int) -> DataFrame:
    """``(topic_a, topic_b, distance)`` of all pairs of topics, a < b.

    Each task sums the divergence of all pairs over its blocks, so only ``k * k`` partial
    sums per task are shuffled.
    """
    first, second = np.triu_indices(k, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, k))
        for batch in batches:
            p = _numbers(batch, k)
            for a in range(k):
                pa_, pb = p[:, [a]], p[:, a + 1 :]
                mean = (pa_ + pb) / 2
                with np.errstate(divide="ignore", invalid="ignore"):
                    left = np.where(pa_ > 0, pa_ * np.log(pa_ / mean), 0.0)
                    right = np.where(pb > 0, pb * np.log(pb / mean), 0.0)
                sums[a, a + 1 :] += ((left + right) / 2).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)), pa.array(sums[first, second])],
            names=["topic_a", "topic_b", "divergence"],
        )

    return (
        blocks.select("weights")
        .mapInArrow(run, "topic_a int, topic_b int, divergence double")
        .groupBy("topic_a", "topic_b")
        .agg(F.sqrt(F.greatest(F.sum("divergence"), F.lit(0.0))).alias("distance"))
    )
