"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versemill.llm.common import add_columns, fold, steps

# Most frequent n-grams of a language and of a document, and the longest n-gram.
PROFILE, LONGEST = 400, 3

FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"

_SPACE = 32
_BITS = 21  # of a code point; three fit one number
_FLUSH = 500_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_lists(texts: list[str]) -> list[np.ndarray]:
    """The n-grams of each text as numbers, each as often as it occurs.

    Words are runs of letters in lower case with a space on either side; no n-gram reaches
    over a space, and the space alone is none.
    """
    lowered = [t.lower() for t in texts]
    joined = "\n" + "\n".join(lowered) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where(_letters()[codes], codes, _SPACE)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    keep[ends] = True  # the space before each text, also after the one that ends the last
    places = np.flatnonzero(keep)
    codes = codes[places]
    bounds = np.searchsorted(places, np.concatenate([[0], ends]))
    space = codes == _SPACE
    grams = []
    for n in range(1, LONGEST + 1):
        count = max(0, len(codes) - n + 1)
        value, valid = np.zeros(count, np.int64), np.ones(count, bool)
        for k in range(n):
            value |= codes[k : k + count] << (_BITS * k)
            if 0 < k < n - 1 or n == 1:
                valid &= ~space[k : k + count]
        if n == 2:
            valid &= ~(space[:count] & space[1 : 1 + count])
        at = np.flatnonzero(valid)
        grams.append((value[at], np.searchsorted(at, bounds)))
    return [
        np.concatenate([value[cut[i] : cut[i + 1]] for value, cut in grams]) for i in range(len(texts))
    ]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(place, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)


def _count(docs: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` of ``(lang, text)``, summed within each task before it leaves."""

    def rows(found: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, parts in found.items():
            grams, counts = _merge(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)],
                names=["lang", "gram", "n"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        size = 0
        for batch in steps(batches):
            langs = batch.column("lang").to_pylist()
            lists = gram_lists([t or "" for t in batch.column("text").to_pylist()])
            for lang in set(langs):
                own = np.concatenate([g for g, of in zip(lists, langs) if of == lang])
                found.setdefault(lang, []).append(np.unique(own, return_counts=True))
                if len(found[lang]) > 16:
                    found[lang] = [_merge(found[lang])]
            size = sum(len(p[0]) for parts in found.values() for p in parts)
            if size > _FLUSH:
                yield from rows(found)
                found = {}
        yield from rows(found)

    return docs.mapInArrow(run, "lang string, gram long, n long")


@dataclass
class Profiles:
    """Ranks of the n-grams of all languages; ``penalty`` where a language lacks one."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    penalty: int

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The nearest language by out-of-place distance and how much nearer it is than the next."""
        names, scores = [], []
        for grams in gram_lists(texts):
            if not len(grams) or not self.languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            distinct, counts = np.unique(grams, return_counts=True)
            top = distinct[np.argsort(-counts, kind="stable")[: self.penalty]]
            place = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
            known = self.grams[place] == top
            ranks = np.where(known[None, :], self.ranks[:, place], -1)
            apart = np.where(ranks >= 0, np.abs(ranks - np.arange(len(top))), self.penalty).sum(axis=1)
            order = np.argsort(apart, kind="stable")
            best = apart[order[0]]
            other = apart[order[1]] if len(order) > 1 else self.penalty * len(top)
            names.append(self.languages[order[0]])
            scores.append(float((other - best) / other) if other else 0.0)
        return names, scores


def learn_profiles(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    size: int = PROFILE,
) -> Profiles:
    """Profiles of the most frequent n-grams of all documents with a language outside the held-out fold.

    Counts cover every whole text. Ties of frequency go by the n-gram's code points. Null
    texts count nothing; without any language all predictions are ``und``.
    """
    known = docs.where(docs[lang_col].isNotNull() & docs[text_col].isNotNull()).where(
        fold(docs[id_col], FOLDS) != HELD_OUT
    )
    counts = _count(
        known.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))
    )
    totals = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_rank = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= size).collect()
    languages = sorted({r["lang"] for r in top})
    grams = np.unique(np.array([r["gram"] for r in top], np.int64))
    ranks = np.full((len(languages), len(grams)), -1, np.int64)
    number = {lang: i for i, lang in enumerate(languages)}
    for r in top:
        ranks[number[r["lang"]], np.searchsorted(grams, r["gram"])] = r["rank"] - 1
    return Profiles(languages, grams, ranks, size)


def identify_language(
    docs: DataFrame, profiles: Profiles, text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` (or all) with ``lang_pred`` and ``lang_score`` (0 to 1).

    A text that is null or has no letter is ``und`` with score 0; equal distances go to the
    language whose name sorts first.
    """

    def kernel(texts: list[str]) -> dict[str, object]:
        names, scores = profiles.predict(texts)
        return {"lang_pred": names, "lang_score": scores}

    return add_columns(docs, kernel, "lang_pred string, lang_score double", text_col, keep)


def held_out(id_column):
    """Whether an id lies in the fold that no language is learned from."""
    return fold(id_column, FOLDS) == HELD_OUT
