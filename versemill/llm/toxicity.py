"""Toxic spans by a linear-chain conditional random field over the words of a document."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from versemill.llm.common import add_columns, fold
from versemill.llm.training import labelled_sample

# Documents of each label that the field is trained on, and their greatest length.
SAMPLE = {1: 1500, 0: 4500}
SAMPLE_CHARS = 12_000

# A word or prefix marks tokens of toxic documents when its log-likelihood ratio and its
# excess of toxic over clean documents reach these values.
LEAST_RATIO, LEAST_LIFT = 22.0, 8.0

FOLDS, HELD_OUT = 5, 0

_EDGES = ".,!?;:\"'()[]{}<>*&%$#@-_/\\…«»„“”‘’¿¡"
_REMEMBERED = 200_000

# Score of a word without known features.
_BIAS = -6.0

# Least marginal that counts towards the mass of a document.
_FLOOR = 0.2

# Tokens of one block of the training.
_TRAIN_TOKENS = 200_000


def _features(raw: str) -> list[str]:
    """Features of one token: the word itself, its beginnings and its last letters."""
    word = raw.strip(_EDGES).lower()
    if not word:
        return []
    return ["=" + word, *(f"{n}{word[:n]}" for n in (3, 4, 5, 6) if len(word) >= n), "<" + word[-3:]]


class _Sample:
    """Tokens of the sampled documents as numbers, and the features of each kind of token."""

    def __init__(self, texts: list[str]):
        kinds: dict[str, int] = {}
        self.documents = [
            np.array([kinds.setdefault(t, len(kinds)) for t in text.split()], np.int32) for text in texts
        ]
        names: dict[str, int] = {}
        owner: list[int] = []
        feature: list[int] = []
        for token, number in kinds.items():
            for name in _features(token):
                owner.append(number)
                feature.append(names.setdefault(name, len(names)))
        self.kinds = len(kinds)
        self.names = list(names)
        self.owner, self.feature = np.array(owner, np.int32), np.array(feature, np.int32)
        self._begin = np.searchsorted(self.owner, np.arange(self.kinds + 1))

    def features_of(self, kinds: np.ndarray) -> np.ndarray:
        """All features of some kinds of token."""
        parts = [self.feature[self._begin[k] : self._begin[k + 1]] for k in np.unique(kinds).tolist()]
        return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int32)

    def marked(self, toxic: np.ndarray) -> np.ndarray:
        """Kinds of token that tell toxic documents from clean ones: these tokens get the label 1.

        A feature is a marker by its document counts alone; last letters are none.
        """
        held = np.zeros((2, len(self.names)), np.int64)
        for document, is_toxic in zip(self.documents, toxic.astype(int).tolist()):
            held[is_toxic, self.features_of(document)] += 1
        n1, n0 = int(toxic.sum()), int((~toxic).sum())
        k1, k0 = held[1].astype(float), held[0].astype(float)
        share = (k1 + k0) / (n1 + n0)
        ratio = np.zeros(len(k1))
        for k, n, p in ((k1, n1, share), (n1 - k1, n1, 1 - share), (k0, n0, share), (n0 - k0, n0, 1 - share)):
            some = k > 0
            ratio[some] += 2 * k[some] * np.log(k[some] / n / p[some])
        lift = (k1 / n1) / ((k0 + 0.5) / (n0 + 1))
        markers = (ratio >= LEAST_RATIO) & (lift >= LEAST_LIFT)
        markers &= np.array([not name.startswith("<") for name in self.names], bool)
        out = np.zeros(self.kinds, bool)
        out[self.owner[markers[self.feature]]] = True
        return out


class _Chains:
    """Sequences of different lengths, stored position by position, longest sequence first."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(lengths), np.int64)
        rank[order] = np.arange(len(lengths))
        longest = int(lengths.max(initial=0))
        self.active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
        self.begin = np.concatenate([[0], np.cumsum(self.active)])
        sequence = np.repeat(np.arange(len(lengths)), lengths)
        position = np.arange(len(sequence)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.place = self.begin[position] + rank[sequence]

    def marginals(self, emission: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of state 1, and expected counts of the start and transition weights.

        ``emission`` is the score of state 1 over state 0 per token in reading order;
        ``weights`` are those of starting in 1 and of the steps 0-1, 1-0 and 1-1.
        """
        start, up, down, stay = weights
        score = np.empty(len(emission))
        score[self.place] = emission
        forward, backward = np.empty(len(score)), np.zeros(len(score))
        steps = len(self.active)
        for t in range(steps):
            here = slice(self.begin[t], self.begin[t + 1])
            if t == 0:
                forward[here] = score[here] + start
            else:
                last = forward[self.begin[t - 1] : self.begin[t - 1] + self.active[t]]
                forward[here] = score[here] + np.logaddexp(up, last + stay) - np.logaddexp(0, last + down)
        for t in range(steps - 2, -1, -1):
            after = slice(self.begin[t + 1], self.begin[t + 2])
            ahead = score[after] + backward[after]
            backward[self.begin[t] : self.begin[t] + self.active[t + 1]] = np.logaddexp(
                down, stay + ahead
            ) - np.logaddexp(0, up + ahead)
        total = forward + backward
        chance = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
        expected = np.zeros(4)
        if steps:
            expected[0] = chance[: self.active[0]].sum()
            nexts = np.arange(self.begin[1], len(score))
            span = np.repeat(np.arange(1, steps), self.active[1:])
            before = nexts - self.begin[span] + self.begin[span - 1]
            ahead, last = score[nexts] + backward[nexts], forward[before]
            terms = np.stack([np.zeros(len(nexts)), up + ahead, last + down, last + stay + ahead])
            terms = np.exp(terms - terms.max(axis=0))
            expected[1:] = (terms[1:] / terms.sum(axis=0)).sum(axis=1)
        return chance[self.place], expected


@dataclass
class ToxicityModel:
    """Weights of the field, and of the document score over its marginals."""

    features: dict[str, float] = field(default_factory=dict)
    bias: float = -12.0
    steps: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    document: tuple[float, float, float] = (-4.0, 0.0, 0.0)

    def __post_init__(self) -> None:
        self._known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_known"} | {"_known": {}}

    def emissions(self, tokens: list[str]) -> np.ndarray:
        known = self._known
        if len(known) > _REMEMBERED:
            known.clear()
        for token in set(tokens).difference(known):
            known[token] = self.bias + sum(self.features.get(f, 0.0) for f in _features(token))
        return np.fromiter(map(known.__getitem__, tokens), float, len(tokens))

    def tag(self, texts: list[str]) -> list[np.ndarray]:
        """The probability of being toxic of every token of every text."""
        tokens = [t.split() for t in texts]
        lengths = np.array([len(t) for t in tokens], np.int64)
        flat = [token for some in tokens for token in some]
        chance, _ = _Chains(lengths).marginals(self.emissions(flat), np.array(self.steps))
        return np.split(chance, np.cumsum(lengths)[:-1]) if len(texts) else []

    def scores(self, chances: list[np.ndarray]) -> np.ndarray:
        base, peak, mass = self.document
        found = _summaries(chances)
        return 1 / (1 + np.exp(-np.clip(base + peak * found[:, 0] + mass * found[:, 1], -40, 40)))


def _summaries(chances: list[np.ndarray]) -> np.ndarray:
    """Highest marginal and logarithm of the expected number of toxic tokens, per document.

    Marginals under ``_FLOOR`` are left out of the sum: many unknown words of a long text
    are no evidence.
    """
    return np.array([(c.max(initial=0.0), math.log1p(c[c >= _FLOOR].sum())) for c in chances]).reshape(-1, 2)


def _train_field(
    sample: _Sample, documents: list[np.ndarray], labels: list[np.ndarray], model: ToxicityModel, rounds: int
) -> None:
    """Maximum likelihood with a ridge penalty, by Adam over all tokens of the documents."""
    blocks = []
    seen = np.zeros(4)
    size, at = 0, 0
    while at < len(documents):
        end, size = at, 0
        while end < len(documents) and (end == at or size + len(documents[end]) <= _TRAIN_TOKENS):
            size += len(documents[end])
            end += 1
        lengths = np.array([len(d) for d in documents[at:end]], np.int64)
        blocks.append((_Chains(lengths), np.concatenate(documents[at:end]), np.concatenate(labels[at:end])))
        at = end
    for label in labels:
        if len(label):
            was, now = label[:-1], label[1:]
            seen += (label[0], ((1 - was) * now).sum(), (was * (1 - now)).sum(), (was * now).sum())
    count = len(sample.names)
    weights = np.zeros(count + 5)
    weights[count] = _BIAS
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    scale = max(1.0, sum(float(label.sum()) for label in labels))
    for step in range(1, rounds + 1):
        by_kind = weights[count] + np.bincount(sample.owner, weights[sample.feature], sample.kinds)
        error, expected = np.zeros(sample.kinds), np.zeros(4)
        for chains, kinds, label in blocks:
            chance, some = chains.marginals(by_kind[kinds], weights[count + 1 :])
            error += np.bincount(kinds, label - chance, sample.kinds)
            expected += some
        by_feature = np.bincount(sample.feature, error[sample.owner], count)
        gradient = np.concatenate([by_feature, [0.0], seen - expected]) / scale
        gradient -= 1e-4 * weights
        gradient[count] = 0.0  # words without known features stay clean
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        weights += 0.4 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        # steps alone never outweigh the bias, so unknown words stay clean in any number
        weights[count + 1 :] = np.minimum(weights[count + 1 :], (0.0, 0.0, 0.0, -_BIAS / 2))
    model.features = {n: float(weights[i]) for i, n in enumerate(sample.names) if abs(weights[i]) > 1e-3}
    model.bias = float(weights[count])
    model.steps = tuple(float(w) for w in weights[count + 1 :])


def _fit_document(found: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic regression by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(found)), found])
    beta, ridge = np.zeros(3), np.diag([1e-3, 0.05, 0.05])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (label - p)) - ridge @ beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge + 1e-6 * np.eye(3), gradient)
        beta += np.clip(step, -2, 2)
    return tuple(float(b) for b in beta)


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: dict[int, int] | None = None,
    sample_chars: int = SAMPLE_CHARS,
    rounds: int = 30,
) -> ToxicityModel:
    """Train on a bounded sample of the labelled documents outside the held-out fold.

    The sample has at most ``sample[label]`` documents per label, of at most
    ``sample_chars`` characters. Documents are labelled, tokens are not: a token of a toxic
    document is labelled toxic when its word or a prefix of it is a marker, that is far
    more frequent in toxic than in clean documents. Without toxic or without clean
    documents the model scores every document by a constant.
    """
    rows, counts = labelled_sample(
        docs, labels, label_col, sample or SAMPLE, FOLDS, HELD_OUT, id_col, text_col, sample_chars
    )
    model = ToxicityModel()
    if not (counts.get(0) and counts.get(1)) or len({label for _, label, _ in rows}) < 2:
        share = counts.get(1, 0) / max(1, sum(counts.values()))
        share = min(max(share, 1e-3), 1 - 1e-3)
        model.document = (math.log(share / (1 - share)), 0.0, 0.0)
        return model
    toxic = np.array([label == 1 for _, label, _ in rows])
    weight = np.array([w for _, _, w in rows])
    found = _Sample([text for text, _, _ in rows])
    marked = found.marked(toxic)
    # the field learns from every toxic document and as many clean ones
    clean = np.flatnonzero(~toxic)[: int(toxic.sum())]
    used = [*np.flatnonzero(toxic).tolist(), *clean.tolist()]
    documents = [found.documents[i] for i in used]
    labels = [(marked[d] & bool(toxic[i])).astype(float) for i, d in zip(used, documents)]
    _train_field(found, documents, labels, model, rounds)
    texts = [text for text, _, _ in rows]
    del found, documents, labels
    summaries = np.concatenate([_summaries(model.tag(texts[at : at + 200])) for at in range(0, len(texts), 200)])
    model.document = _fit_document(summaries, toxic.astype(float), weight / weight.mean())
    return model


def spans(text: str, chances: np.ndarray, threshold: float = 0.5) -> list[tuple[int, int]]:
    """Character offsets (end exclusive) of runs of tokens with a marginal of at least ``threshold``."""
    if not (chances >= threshold).any():
        return []
    out: list[tuple[int, int]] = []
    last = -2
    for i, match in enumerate(re.finditer(r"\S+", text)):
        if chances[i] >= threshold:
            if last == i - 1:
                out[-1] = (out[-1][0], match.end())
            else:
                out.append((match.start(), match.end()))
            last = i
    return out


def score_toxicity(
    docs: DataFrame,
    model: ToxicityModel,
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (or all) with ``toxicity`` (0 to 1) and ``toxic_spans``.

    Every whole text is tagged; a null text counts as empty and gets the score of a
    document without toxic tokens.
    """

    def kernel(texts: list[str]) -> dict[str, object]:
        chances = model.tag(texts)
        found = [spans(t, c) for t, c in zip(texts, chances)]
        return {
            "toxicity": model.scores(chances),
            "toxic_spans": [[{"start": s, "end": e} for s, e in some] for some in found],
        }

    return add_columns(
        docs, kernel, "toxicity double, toxic_spans array<struct<start: int, end: int>>", text_col, keep
    )


def held_out(id_column):
    """Whether an id lies in the fold that no label is learned from."""
    return fold(id_column, FOLDS) == HELD_OUT
