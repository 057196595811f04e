"""Truncated singular vectors of a sparse matrix by distributed random projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Features in one block of a partial product.
_BLOCK = 1024


def _dense(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, features and weights of a batch of sparse rows."""
    features = batch.column("features")
    starts = features.offsets.to_numpy()
    return (
        starts - starts[0],
        features.flatten().to_numpy(),
        batch.column("weights").flatten().to_numpy().astype(np.float32),
    )


def _times(rows: tuple[np.ndarray, np.ndarray, np.ndarray], right: np.ndarray) -> np.ndarray:
    """The sparse rows times a dense matrix."""
    starts, features, weights = rows
    out = np.zeros((len(starts) - 1, right.shape[1]), np.float32)
    filled = np.flatnonzero(np.diff(starts))
    if len(filled):
        out[filled] = np.add.reduceat(right[features] * weights[:, None], starts[:-1][filled], axis=0)
    return out


# Rows multiplied at once: an array of their features x rank numbers stays near 10 MB.
_ROWS = 512


def _gram_times(matrix: DataFrame, right: np.ndarray) -> np.ndarray:
    """``A' A right``, summed block by block of features; the result has the size of ``right``."""
    shared = matrix.sparkSession.sparkContext.broadcast(right)  # features x rank, whatever the data

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(shared.value)
        pieces = (batch.slice(at, _ROWS) for batch in batches for at in range(0, batch.num_rows, _ROWS))
        for piece in pieces:
            rows = _dense(piece)
            product = _times(rows, shared.value)
            owner = np.repeat(np.arange(len(rows[0]) - 1), np.diff(rows[0]))
            order = np.argsort(rows[1], kind="stable")
            features, begin = np.unique(rows[1][order], return_index=True)
            if len(features):
                parts = product[owner[order]] * rows[2][order][:, None]
                total[features] += np.add.reduceat(parts, begin, axis=0)
        for at in range(0, len(total), _BLOCK):
            yield pa.RecordBatch.from_arrays(
                [pa.array([at // _BLOCK], pa.int32()), pa.array([total[at : at + _BLOCK].tobytes()], pa.binary())],
                names=["block", "part"],
            )

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in parts:
            for part in batch.column("part").to_pylist():
                some = np.frombuffer(part, np.float32)
                total = some.copy() if total is None else total + some
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "part"])

    schema = "block int, part binary"
    blocks = matrix.mapInArrow(partial, schema).groupBy("block").applyInArrow(add, schema).collect()
    shared.destroy()
    out = np.zeros_like(right)
    for row in blocks:
        part = np.frombuffer(row["part"], np.float32).reshape(-1, right.shape[1])
        out[row["block"] * _BLOCK : row["block"] * _BLOCK + len(part)] = part
    return out


def right_singular_vectors(
    matrix: DataFrame, features: int, rank: int, oversampling: int = 8, rounds: int = 1, seed: int = 7
) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors (features x rank) and values of a matrix.

    ``matrix`` has a row per ``(features array<int>, weights array<float>)``. A random
    subspace is sharpened by ``rounds`` products with ``A' A``; each is one pass, and the
    driver holds features x (rank + oversampling) numbers.
    """
    random = np.random.Generator(np.random.PCG64(seed))
    basis = random.standard_normal((features, rank + oversampling)).astype(np.float32)
    for _ in range(rounds):
        basis = np.linalg.qr(_gram_times(matrix, np.ascontiguousarray(basis, dtype=np.float32)))[0].astype(np.float32)
    small = basis.T.astype(float) @ _gram_times(matrix, np.ascontiguousarray(basis)).astype(float)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-values)[:rank]
    best = best[values[best] > 1e-6 * max(values.max(initial=0.0), 1e-12)]
    return (basis @ vectors[:, best]).astype(np.float32), np.sqrt(values[best])
