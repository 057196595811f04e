"""Quality of documents by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from versemill.llm.common import add_columns, fold, plain_letters, text_bytes, word_hashes
from versemill.llm.training import labelled_sample

# Documents of each label that the trees are trained on.
SAMPLE = {0: 15_000, 1: 15_000}

TREES, DEPTH, BINS, RATE = 80, 4, 64, 0.15

FOLDS, HELD_OUT = 5, 0

# Classes of bytes whose shares are statistics.
_CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "mark", "symbol", "beyond")

STATISTICS = (
    *(f"share_{c}" for c in _CLASSES),
    "log_bytes",
    "log_words",
    "word_length",
    "word_length_spread",
    "longest_word",
    "distinct_words",
    "commonest_word",
    "repeated_pairs",
    "repeated_fives",
    "log_lines",
    "distinct_lines",
    "words_per_line",
    "upper_of_letters",
    "stops_per_word",
    "symbols_per_word",
    "short_words",
)


def _byte_classes() -> np.ndarray:
    table = np.full(256, _CLASSES.index("symbol"), np.int64)
    for b in range(128):
        c = chr(b)
        if c.islower():
            table[b] = _CLASSES.index("lower")
        elif c.isupper():
            table[b] = _CLASSES.index("upper")
        elif c.isdigit():
            table[b] = _CLASSES.index("digit")
        elif c in " \t":
            table[b] = _CLASSES.index("space")
        elif c in "\n\r\v\f":
            table[b] = _CLASSES.index("line")
        elif c in ".!?":
            table[b] = _CLASSES.index("stop")
        elif c in ",;:'\"()-":
            table[b] = _CLASSES.index("mark")
    table[128:] = _CLASSES.index("beyond")
    return table


def _repeated(keys: np.ndarray) -> float:
    """Share of entries that repeat an earlier one."""
    return 1 - len(np.unique(keys)) / len(keys) if len(keys) else 0.0


def _line_letters() -> np.ndarray:
    """Lines as 'words': all bytes but line ends."""
    table = np.arange(256, dtype=np.uint8)
    table[[10, 11, 12, 13]] = 0
    return table


def statistics(texts: list[str]) -> np.ndarray:
    """A row of :data:`STATISTICS` per text; all 0 for an empty one."""
    column = pa.array(texts, pa.large_string())
    data, offsets = text_bytes(column)
    classes = _byte_classes()[data]
    words, firsts = word_hashes(column, plain_letters())
    lines, first_lines = word_hashes(column, _line_letters())
    is_space = np.isin(classes, (_CLASSES.index("space"), _CLASSES.index("line")))
    out = np.zeros((len(texts), len(STATISTICS)))
    for i in range(len(texts)):
        begin, end = offsets[i], offsets[i + 1]
        n = end - begin
        if not n:
            continue
        counts = np.bincount(classes[begin:end], minlength=len(_CLASSES))
        gaps = np.flatnonzero(np.concatenate([[True], is_space[begin:end], [True]]))
        lengths = np.diff(gaps) - 1
        lengths = lengths[lengths > 0]
        own, rows = words[firsts[i] : firsts[i + 1]], lines[first_lines[i] : first_lines[i + 1]]
        w, letters = max(1, len(own)), max(1, counts[0] + counts[1])
        commonest = np.unique(own, return_counts=True)[1].max(initial=0)
        fives = own[:-4] + 3 * own[1:-3] + 5 * own[2:-2] + 7 * own[3:-1] + 11 * own[4:] if len(own) > 4 else own[:0]
        out[i] = (
            *(counts / n),
            math.log1p(n),
            math.log1p(len(own)),
            lengths.mean() if len(lengths) else 0.0,
            lengths.std() if len(lengths) else 0.0,
            lengths.max(initial=0),
            1 - _repeated(own),
            commonest / w,
            _repeated(own[:-1] * np.uint64(3) + own[1:]) if len(own) > 1 else 0.0,
            _repeated(fives),
            math.log1p(len(rows)),
            1 - _repeated(rows),
            len(own) / max(1, len(rows)),
            counts[1] / letters,
            counts[_CLASSES.index("stop")] / w,
            counts[_CLASSES.index("symbol")] / w,
            (lengths <= 3).sum() / w,
        )
    return out


@dataclass
class QualityModel:
    """Complete binary trees in arrays: children of node ``i`` are ``2 i + 1`` and ``2 i + 2``."""

    edges: list[np.ndarray]
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    base: float

    def bins(self, rows: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, rows[:, i], side="left") for i, e in enumerate(self.edges)])

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; every level moves all rows in all trees at once."""
        total = np.full(len(rows), self.base)
        if len(self.feature) and len(rows):
            binned, tree = self.bins(rows), np.arange(len(self.feature))[None, :]
            node = np.zeros((len(rows), len(self.feature)), np.int64)
            for _ in range(DEPTH):
                above = np.take_along_axis(binned, self.feature[tree, node], axis=1) > self.limit[tree, node]
                node = 2 * node + 1 + above
            total = total + self.value[tree, node - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def boost(
    rows: np.ndarray, label: np.ndarray, weight: np.ndarray, trees: int = TREES, bins: int = BINS, rate: float = RATE
) -> QualityModel:
    """Fit trees to the logistic loss; each split is the best of the gradient histograms."""
    edges = [np.unique(np.quantile(rows[:, i], np.linspace(0, 1, bins + 1)[1:-1])) for i in range(rows.shape[1])]
    share = float(np.clip((weight * label).sum() / weight.sum(), 1e-4, 1 - 1e-4))
    inner = 2**DEPTH - 1
    model = QualityModel(
        edges,
        np.zeros((trees, inner), np.int64),
        np.full((trees, inner), bins, np.int64),
        np.zeros((trees, inner + 1)),
        math.log(share / (1 - share)),
    )
    binned = model.bins(rows)
    ridge, least = 1.0, 1e-3 * weight.sum()
    total = np.full(len(rows), model.base)
    for t in range(trees):
        chance = 1 / (1 + np.exp(-total))
        gradient, curve = weight * (label - chance), weight * chance * (1 - chance)
        node = np.zeros(len(rows), np.int64)
        for depth in range(DEPTH):
            first, count = 2**depth - 1, 2**depth
            here = node - first
            best = np.zeros(count)
            for f in range(rows.shape[1]):
                slot = here * bins + binned[:, f]
                g = np.bincount(slot, gradient, count * bins).reshape(count, bins).cumsum(axis=1)
                h = np.bincount(slot, curve, count * bins).reshape(count, bins).cumsum(axis=1)
                mass = np.bincount(slot, weight, count * bins).reshape(count, bins).cumsum(axis=1)
                gain = (
                    g**2 / (h + ridge)
                    + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge)
                    - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                )
                gain[(mass < least) | (mass[:, -1:] - mass < least)] = 0
                at = gain.argmax(axis=1)
                found = gain[np.arange(count), at]
                better = found > best + 1e-9
                best[better] = found[better]
                model.feature[t, first : first + count][better] = f
                model.limit[t, first : first + count][better] = at[better]
            above = binned[np.arange(len(rows)), model.feature[t, node]] > model.limit[t, node]
            node = 2 * node + 1 + above
        leaf = node - inner
        g = np.bincount(leaf, gradient, inner + 1)
        h = np.bincount(leaf, curve, inner + 1)
        model.value[t] = rate * g / (h + ridge)
        total = total + model.value[t, leaf]
    return model


def _with_statistics(docs: DataFrame) -> DataFrame:
    return add_columns(
        docs, lambda texts: {"value": list(statistics(texts))}, "value array<double>", keep=["doc_id"]
    )


def train_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: dict[int, int] | None = None,
) -> QualityModel:
    """Train on a bounded sample of labelled documents outside the held-out fold.

    Workers reduce each sampled text to its statistics; the driver gets a row of numbers
    per document, at most ``sample[label]`` rows per label, weighted to the label counts.
    With one label only, or none, the score is constant.
    """
    rows, counts = labelled_sample(
        docs, labels, label_col, sample or SAMPLE, FOLDS, HELD_OUT, id_col, text_col, shape=_with_statistics
    )
    label = np.array([r[1] for r in rows], float)
    if len(set(label.tolist())) < 2:
        share = min(max(counts.get(1, 0) / max(1, sum(counts.values())), 1e-3), 1 - 1e-3) if counts else 0.5
        empty = np.empty((0, 2**DEPTH), np.int64)
        return QualityModel([], empty, empty, empty.astype(float), math.log(share / (1 - share)))
    weight = np.array([r[2] for r in rows])
    return boost(np.array([r[0] for r in rows]), label, weight / weight.mean())


def score_quality(
    docs: DataFrame, model: QualityModel, text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` (or all) with ``quality`` (0 to 1, higher is better).

    Every whole text is scored; null and empty texts have the same statistics, all 0.
    """

    def kernel(texts: list[str]) -> dict[str, object]:
        return {"quality": model.score(statistics(texts))}

    return add_columns(docs, kernel, "quality double", text_col, keep)


def held_out(id_column):
    """Whether an id lies in the fold that no label is learned from."""
    return fold(id_column, FOLDS) == HELD_OUT
