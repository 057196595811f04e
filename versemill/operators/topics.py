"""LDA topic models on MLlib: fitting, inspection, selection, storage."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import LDA, LDAModel, LocalLDAModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versemill.operators.coherence import topic_coherence
from versemill.operators.topic_bound import likelihood_bound
from versemill.operators.vocabulary import vectorize, vocabulary_terms
from versemill.staging import stage

# Default training settings.
N_TOPICS, PASSES, OFFSET, DECAY = 10, 30, 1.0, 0.5

# Share of the documents that a step samples, at any size of the corpus.
SAMPLING_RATE = 0.2

# Most fits at a time. Each keeps the vectors for itself: so many bytes an entry, and for a
# document besides.
FITS_AT_ONCE, ENTRY_BYTES, VECTOR_BYTES = 4, 12, 120


@dataclass(frozen=True)
class Corpus:
    """Tokens, count vectors and vocabulary of one document set.

    ``documents`` is a written table ``(id, tokens, features)``, so every fit starts from it
    rather than from the raw text.
    """

    documents: DataFrame
    terms: Sequence[str]
    n_docs: int


@dataclass(frozen=True)
class TopicModel:
    """A fitted model and the terms of its matrix, in column order."""

    model: LDAModel
    terms: Sequence[str]
    k: int


def make_corpus(df: DataFrame, vocabulary: DataFrame, column: str = "tokens", key: str = "id") -> Corpus:
    """Vectorise documents once for any number of fits."""
    terms = vocabulary_terms(vocabulary)
    if not terms:
        raise ValueError("the vocabulary is empty")
    documents = stage(vectorize(df.select(key, F.col(column).alias("tokens")), terms), "corpus")
    return Corpus(documents, terms, documents.count())


def document_prior(alpha: str, k: int) -> list[float] | None:
    """Topic weights of a document before it is read: ``symmetric`` or ``asymmetric``."""
    if alpha in ("symmetric", "auto"):
        return [1.0 / k] * k
    if alpha == "asymmetric":
        raw = [1.0 / (i + math.sqrt(k)) for i in range(k)]
        return [x / sum(raw) for x in raw]
    raise ValueError(f"unknown alpha {alpha!r}")


def lda_fit(
    corpus: Corpus,
    k: int = N_TOPICS,
    passes: int = PASSES,
    chunksize: int | None = None,
    alpha: str = "symmetric",
    eta: str = "symmetric",
    seed: int = 0,
    sampling_rate: float = SAMPLING_RATE,
    offset: float = OFFSET,
    decay: float = DECAY,
) -> TopicModel:
    """Fit one model by online variational Bayes.

    A step learns from a random sample of the documents, the share ``sampling_rate`` or
    about ``chunksize`` documents if that is given; a pass is as many steps as make up the
    corpus. Step ``t`` weighs ``(offset + t) ** -decay``: a small offset forgets the random
    start soon. MLlib cannot learn the term prior, so ``eta="auto"`` uses the symmetric value.
    The vectors are read from the written table once and kept by MLlib as objects, in memory
    or on disk, until the fit ends: a cached frame would be decoded and checked by every step.
    """
    if eta not in ("symmetric", "auto"):
        raise ValueError(f"unknown eta {eta!r}")
    if chunksize is not None:
        sampling_rate = min(1.0, chunksize / max(1, corpus.n_docs))
    steps = passes * math.ceil(1 / sampling_rate)
    lda = LDA(
        k=k,
        optimizer="online",
        maxIter=steps,
        subsamplingRate=sampling_rate,
        learningOffset=offset,
        learningDecay=decay,
        docConcentration=document_prior(alpha, k),
        topicConcentration=1.0 / k,
        optimizeDocConcentration=alpha == "auto",
        seed=seed,
        featuresCol="features",
    )
    return TopicModel(lda.fit(corpus.documents.select("features")), corpus.terms, k)


def _terms_frame(spark: SparkSession, terms: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(terms)), "term_id int, term string")


def term_probabilities(fitted: TopicModel) -> np.ndarray:
    """The probabilities of the terms, terms x topics."""
    weights = fitted.model.topicsMatrix().toArray()
    return weights / weights.sum(axis=0)


def lda_topic_terms(fitted: TopicModel, n_terms: int = 10) -> DataFrame:
    """``(topic, rank, term, weight)``: the top terms of each topic, ties by place in the vocabulary.

    The best are picked from the model's matrix without sorting it; the frame holds them alone.
    """
    found = []
    for topic, column in enumerate(term_probabilities(fitted).T):
        n = min(n_terms, len(column))
        at = np.flatnonzero(column >= np.partition(column, len(column) - n)[len(column) - n]) if n else []
        best = sorted(at, key=lambda i: (-column[i], i))[:n]
        found += [(topic, rank, fitted.terms[i], float(column[i])) for rank, i in enumerate(best, 1)]
    return SparkSession.active().createDataFrame(found, "topic int, rank int, term string, weight double")


def topic_distribution(fitted: TopicModel, documents: DataFrame) -> DataFrame:
    """``documents`` with the array ``theta`` of topic weights."""
    return fitted.model.transform(documents).withColumn("theta", vector_to_array("topicDistribution"))


def lda_doc_topics(fitted: TopicModel, documents: DataFrame, key: str = "id") -> DataFrame:
    """``(id, topic, weight)`` for every document and topic."""
    return topic_distribution(fitted, documents).select(key, F.posexplode("theta").alias("topic", "weight"))


def dominant_topic(theta: str) -> Column:
    """The heaviest topic of an array of weights; the first of equal ones."""
    return (F.array_position(theta, F.array_max(theta)) - 1).cast("int")


def lda_dominant_topic(fitted: TopicModel, documents: DataFrame, key: str = "id") -> DataFrame:
    """``(id, topic, weight)`` of the heaviest topic; the first of equal ones."""
    return topic_distribution(fitted, documents).select(
        key, dominant_topic("theta").alias("topic"), F.array_max("theta").alias("weight")
    )


def lda_perplexity(fitted: TopicModel, documents: DataFrame) -> float:
    """Per-word likelihood bound; higher is better."""
    bound, tokens = likelihood_bound(fitted.model, documents)
    return bound / tokens


def lda_log_likelihood(fitted: TopicModel, documents: DataFrame) -> float:
    """Likelihood bound of the whole document set."""
    return likelihood_bound(fitted.model, documents)[0]


def _settings_frame(spark: SparkSession, settings: Sequence[tuple[int, str, str]]) -> DataFrame:
    rows = [(i, *s) for i, s in enumerate(settings)]
    return spark.createDataFrame(rows, "model int, topics int, alpha string, eta string")


def fits_at_once(corpus: Corpus, most: int = FITS_AT_ONCE) -> int:
    """How many fits may run at a time: their vectors have room in the memory for cached data."""
    context = corpus.documents.sparkSession.sparkContext
    status = context._jsc.sc().getExecutorMemoryStatus().values().iterator()
    room = 0
    while status.hasNext():
        room += status.next()._2()
    # a vector has no more entries than its document has tokens
    entries = corpus.documents.agg(F.sum(F.size("tokens").cast("long"))).first()[0] or 0
    size = ENTRY_BYTES * entries + VECTOR_BYTES * corpus.n_docs
    return max(1, min(most, room // max(1, size)))


def lda_grid_search(
    corpus: Corpus,
    ks: Iterable[int],
    alphas: Sequence[str] = ("symmetric", "asymmetric"),
    etas: Sequence[str] = ("symmetric",),
    top_words: int = 20,
    parallelism: int | None = None,
    **training: int,
) -> tuple[DataFrame, list[TopicModel]]:
    """Fit a model per setting and score them all in one pass over the texts.

    ``parallelism`` fits run at a time, by default as :func:`fits_at_once` tells: a step waits
    for its slowest task and for the driver, while the steps of other fits go on. Returns
    ``(model, topics, alpha, eta, coherence)`` and the models in that order.
    """
    settings = [(k, a, e) for k in ks for a in alphas for e in etas]
    spark = corpus.documents.sparkSession

    def fit(setting: tuple[int, str, str]) -> TopicModel:
        k, a, e = setting
        return lda_fit(corpus, k, alpha=a, eta=e, **training)

    parallelism = fits_at_once(corpus) if parallelism is None else parallelism
    with ThreadPool(max(1, min(parallelism, len(settings)))) as pool:
        models = pool.map(inheritable_thread_target(spark)(fit), settings, chunksize=1)
    words = [
        lda_topic_terms(fitted, top_words).withColumn("topic", F.struct(F.lit(i).alias("model"), "topic"))
        for i, fitted in enumerate(models)
    ]
    scores = (
        topic_coherence(corpus.documents, reduce(DataFrame.unionByName, words), top_words=top_words)
        .groupBy(F.col("topic.model").alias("model"))
        .agg(F.avg("coherence").alias("coherence"))
    )
    results = stage(_settings_frame(spark, settings).join(scores, "model"), "grid-results")
    return results, models


def lda_sweep_k(corpus: Corpus, ks: Iterable[int], alpha: str = "symmetric", eta: str = "symmetric", **training: int):
    """Coherence by number of topics: ``(k, coherence)`` and the models."""
    results, models = lda_grid_search(corpus, ks, [alpha], [eta], **training)
    return results.select(F.col("topics").alias("k"), "coherence"), models


def best_model(results: DataFrame, models: Sequence[TopicModel]) -> TopicModel:
    """The first model with the highest coherence."""
    return models[results.orderBy(F.desc("coherence"), "model").first().model]


def save_topic_model(
    fitted: TopicModel, directory: str, coherence: float | None = None, when: datetime | None = None
) -> str:
    """Save model, terms and coherence below a dated directory; returns its path."""
    path = f"{directory.rstrip('/')}/{(when or datetime.now()):%d%m%Y_%H%M%S}"
    fitted.model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    _terms_frame(spark, fitted.terms).write.mode("overwrite").parquet(f"{path}/terms")
    info = spark.createDataFrame([(fitted.k, coherence)], "k int, coherence double")
    info.write.mode("overwrite").parquet(f"{path}/info")
    return path


def load_topic_model(path: str) -> tuple[TopicModel, float | None]:
    """Load what :func:`save_topic_model` wrote."""
    spark = SparkSession.active()
    info = spark.read.parquet(f"{path}/info").first()
    terms = [row.term for row in spark.read.parquet(f"{path}/terms").orderBy("term_id").collect()]
    return TopicModel(LocalLDAModel.load(f"{path}/model"), terms, info.k), info.coherence
