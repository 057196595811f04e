"""Small tables for the operators; every one has a column whose name an operator also uses."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, kept string, row string, score string"


def documents(spark, rows, langs=None):
    """``rows`` of (doc_id, text)."""
    return spark.createDataFrame(
        [(i, t, (langs or {}).get(i, "en"), "k", "r", "s") for i, t in rows], SCHEMA
    )


def prose(seed, words, vocabulary=400):
    generator = random.Random(seed)
    stems = ["ka", "lo", "mi", "ren", "tu", "sor", "ve", "nim", "pol", "da"]
    made = ["".join(generator.choices(stems, k=generator.randint(1, 3))) for _ in range(words)]
    return " ".join(made)
