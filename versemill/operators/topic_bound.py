"""The likelihood bound of a topic model, summed over any number of documents.

MLlib's own bound evaluates the whole topic-term matrix again for every document. Here the
matrix is prepared once, and a document costs only its own terms. A small matrix is
broadcast; a larger one is met block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import LDAModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.joins import BROADCAST_BYTES
from versemill.operators.topic_matrix import BLOCK_TERMS, write_blocks
from versemill.staging import stage

# Documents for which a block of the matrix is repeated once.
PIECES = 200_000

# cells of the largest array made at once
CELLS = 4_000_000


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers, by recurrence and asymptotic series."""
    x = np.array(x, dtype=float)
    out = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        out[small] -= np.log(x[small])
        x[small] += 1
    square = 1 / x**2
    series = 1 / 12 - square * (1 / 360 - square * (1 / 1260 - square * (1 / 1680 - square / 1188)))
    return out + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series / x


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log gamma for positive numbers, by recurrence and asymptotic series."""
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    for _ in range(6):
        small = x < 6
        shift = np.where(small, shift - 1 / x, shift)
        x = np.where(small, x + 1, x)
    r = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def token_count(features: str = "features") -> Column:
    """Tokens counted by a sparse vector, without making it dense."""
    return F.aggregate(F.unwrap_udt(F.col(features)).getField("values"), F.lit(0.0), lambda a, x: a + x)


def _of_documents(
    theta: np.ndarray, lengths: np.ndarray, alpha: np.ndarray
) -> tuple[np.ndarray, float]:
    """Expected log weights of documents, and the part of their bound that needs no term."""
    # in variational inference the pseudo counts of a document sum up to this
    total = alpha.sum() + lengths
    gamma = theta * total[:, None]
    log_theta = digamma(gamma) - digamma(total)[:, None]
    bound = ((alpha - gamma) * log_theta).sum() + (log_gamma(gamma) - log_gamma(alpha)).sum()
    return log_theta, bound + len(theta) * lgamma(alpha.sum()) - log_gamma(total).sum()


def _of_terms(log_theta: np.ndarray, document: np.ndarray, log_beta: np.ndarray, counts: np.ndarray) -> float:
    """The part of the bound of terms with these rows of the matrix, in bounded arrays."""
    bound, step = 0.0, max(1, CELLS // log_theta.shape[1])
    for at in range(0, len(document), step):
        logits = log_theta[document[at : at + step]] + log_beta[at : at + step]
        top = logits.max(axis=1)
        bound += counts[at : at + step] @ (top + np.log(np.exp(logits - top[:, None]).sum(axis=1)))
    return bound


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists, and the length of each list."""
    return column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False)


def _read(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, ...]:
    terms, sizes = _lists(batch.column("indices"))
    counts, _ = _lists(batch.column("values"))
    document = np.repeat(np.arange(len(sizes)), sizes)
    lengths = np.bincount(document, counts, minlength=len(sizes))
    return terms, counts, document, lengths, _lists(batch.column("theta"))[0].reshape(-1, k)


def _by_broadcast(documents: DataFrame, expected_log: np.ndarray, alpha: np.ndarray) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(np.ascontiguousarray(expected_log))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = tokens = 0.0
        for batch in batches:
            terms, counts, document, lengths, theta = _read(batch, len(alpha))
            log_theta, part = _of_documents(theta, lengths, alpha)
            step = max(1, CELLS // len(alpha))
            for at in range(0, len(terms), step):
                here = slice(at, at + step)
                part += _of_terms(log_theta, document[here], shared.value[terms[here]], counts[here])
            bound, tokens = bound + part, tokens + lengths.sum()
        yield pa.RecordBatch.from_pydict({"bound": [float(bound)], "tokens": [float(tokens)]})

    return documents.mapInArrow(run, "bound double, tokens double")


_PIECE = "block long, salt int, kind int, places array<int>, counts array<double>, numbers array<double>, bound double, tokens double"


def _by_blocks(documents: DataFrame, expected_log: np.ndarray, alpha: np.ndarray) -> DataFrame:
    """The same where no task may hold the matrix.

    Documents are cut into pieces by blocks of terms, and each piece meets its block: the
    block comes first in its part of a sorted partition, and the pieces stream by. A block
    is repeated for every ``PIECES`` documents, so frequent terms burden no single task.
    """
    spark, k = documents.sparkSession, len(alpha)
    width = BLOCK_TERMS
    salts = -(-documents.count() // PIECES)
    blocks = write_blocks(spark, expected_log, None, width).select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(max(0, salts - 1)))).alias("salt"), F.lit(0).alias("kind"),
        F.lit(None).cast("array<int>").alias("places"), F.lit(None).cast("array<double>").alias("counts"),
        F.col("weights").alias("numbers"), F.lit(0.0).alias("bound"), F.lit(0.0).alias("tokens"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "salt", "kind", "places", "counts", "numbers", "bound", "tokens"]
        schema = pa.schema(
            zip(names, [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()),
                        pa.list_(pa.float64()), pa.float64(), pa.float64()])
        )
        turn = 0
        for batch in batches:
            terms, counts, document, lengths, theta = _read(batch, k)
            log_theta, bound = _of_documents(theta, lengths, alpha)
            # terms of a vector ascend, so the pieces of a document lie together
            piece = document * np.int64(len(expected_log) // width + 1) + terms // width
            starts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]])[: len(piece)])
            ends = np.append(starts[1:], len(piece))
            owner, block = document[starts], terms[starts] // width
            offsets = pa.array(np.append(starts, len(piece)).astype(np.int32))
            rows = [
                pa.array(block.astype(np.int64)),
                pa.array(((turn + owner) % salts).astype(np.int32)),
                pa.array(np.ones(len(starts), np.int32)),
                pa.ListArray.from_arrays(offsets, pa.array((terms - terms // width * width).astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(counts)),
                pa.ListArray.from_arrays(
                    pa.array((np.arange(len(starts) + 1) * k).astype(np.int32)), pa.array(log_theta[owner].ravel())
                ),
                pa.array(np.zeros(len(starts))),
                pa.array(np.zeros(len(starts))),
            ]
            turn += len(theta)
            yield pa.RecordBatch.from_arrays(rows, schema=schema)
            yield pa.RecordBatch.from_pylist(
                [dict(zip(names, (-1, turn % salts, 1, [], [], [], float(bound), float(lengths.sum()))))], schema=schema
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = tokens = 0.0
        matrix = np.empty((0, k))
        for batch in batches:
            bound += pc.sum(batch.column("bound")).as_py() or 0.0
            tokens += pc.sum(batch.column("tokens")).as_py() or 0.0
            kind = batch.column("kind").to_numpy()
            edges = np.unique(np.concatenate([[0], np.flatnonzero(kind == 0), np.flatnonzero(kind == 0) + 1, [len(kind)]]))
            for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                part = batch.slice(begin, end - begin)
                numbers = _lists(part.column("numbers"))[0].reshape(-1, k)
                if kind[begin] == 0:
                    matrix = numbers
                    continue
                places, sizes = _lists(part.column("places"))
                if len(places):
                    # rows without terms carry no numbers either
                    owner = np.repeat(np.cumsum(sizes > 0) - 1, sizes)
                    counts = _lists(part.column("counts"))[0]
                    step = max(1, CELLS // k)
                    for at in range(0, len(places), step):
                        here = slice(at, at + step)
                        bound += _of_terms(numbers, owner[here], matrix[places[here]], counts[here])
        yield pa.RecordBatch.from_pydict({"bound": [float(bound)], "tokens": [float(tokens)]})

    met = documents.mapInArrow(cut, _PIECE).union(blocks).repartition("block", "salt")
    return met.sortWithinPartitions("block", "salt", "kind").mapInArrow(meet, "bound double, tokens double")


def likelihood_bound(
    model: LDAModel, documents: DataFrame, features: str = "features", max_bytes: int = BROADCAST_BYTES
) -> tuple[float, float]:
    """``(bound, tokens)``: the variational bound on the log likelihood and the token count.

    The matrix is broadcast if it takes at most ``max_bytes``; beyond that, documents and
    matrix are joined by blocks of terms, and only sums of blocks come together.
    """
    weights = model.topicsMatrix().toArray()
    alpha = np.asarray(model.estimatedDocConcentration().toArray())
    eta = model.getTopicConcentration()
    expected_log = digamma(weights) - digamma(weights.sum(axis=0))

    vector = F.unwrap_udt(F.col(features))
    inferred = model.transform(documents.where(F.size(vector.getField("indices")) > 0).select(features)).select(
        vector.getField("indices").alias("indices"),
        vector.getField("values").alias("values"),
        vector_to_array("topicDistribution").alias("theta"),
    )
    if expected_log.nbytes <= max_bytes:
        parts = _by_broadcast(inferred, expected_log, alpha)
    else:
        parts = _by_blocks(stage(inferred, "inferred"), expected_log, alpha)
    sums = parts.agg(F.sum("bound").alias("bound"), F.sum("tokens").alias("tokens")).first()
    if not sums.tokens:
        raise ValueError("no document holds a term of the model")
    terms, k = weights.shape
    topics = ((eta - weights) * expected_log).sum() + log_gamma(weights).sum() - weights.size * lgamma(eta)
    topics += k * lgamma(eta * terms) - log_gamma(weights.sum(axis=0)).sum()
    return float(sums.bound + topics), float(sums.tokens)
