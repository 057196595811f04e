"""Labelled documents for the classifiers: a bounded sample, the same in every run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.llm.common import fold, read_documents


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    most: dict[int, int],
    folds: int,
    held_out: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_chars: int | None = None,
    shape: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[list[tuple], dict[int, int]]:
    """``(value, label, weight)`` of at most ``most[label]`` documents per label, and all label counts.

    The value is the text, or what ``shape`` makes of ``(doc_id, text)`` as the column ``value``.

    Only documents outside the fold ``held_out`` count. The sample takes the ids with the
    smallest hashes, so it does not depend on the partitions; the weight of a document is
    the number of labelled documents that it stands for. Of several labels of one id the
    largest holds; ids without a label, null ids and null labels are left out.
    """
    known = (
        labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label"))
        .where("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .where(fold(F.col("doc_id"), folds) != held_out)
    )
    counts = {int(r["label"]): int(r["n"]) for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    texts = read_documents(docs, id_col, text_col)
    usable: Column = F.lit(True) if max_chars is None else F.length("text") <= max_chars
    sample = []
    for label, limit in sorted(most.items()):
        chosen = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        found = texts.join(F.broadcast(chosen), "doc_id").where(usable)  # at most ``limit`` ids
        found = found.select("doc_id", "text").dropDuplicates(["doc_id"])
        rows = shape(found).collect() if shape else found.select("doc_id", F.col("text").alias("value")).collect()
        rows.sort(key=lambda r: r["doc_id"])
        weight = counts.get(label, 0) / len(rows) if rows else 0.0
        sample += [(r["value"], label, weight) for r in rows]
    return sample, counts
