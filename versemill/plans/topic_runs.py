"""Topic models per decade and per genre."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextvars import copy_context
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.operators import phrases, topics, vocabulary
from versemill.operators.columns import filter_genre_decade
from versemill.operators.coherence import topic_coherence
from versemill.plans.corpus import phrase_tokens
from versemill.staging import stage

# Decades modelled by default.
DECADES = (1960, 1970, 1980, 1990, 2000, 2010, 2020)

# Models fitted at a time: a group's corpus is rarely large enough to fill a cluster.
PARALLELISM = 4


@dataclass(frozen=True)
class DecadeRun:
    """A decade's corpus, its (best) model and, after a grid search, the grid results."""

    decade: int
    corpus: topics.Corpus
    fitted: topics.TopicModel
    grid: DataFrame | None


def in_pools(df: DataFrame, tasks: dict[str, Callable[[], object]], parallelism: int) -> list[object]:
    """Run independent jobs at a time, each in a scheduler pool of its own, and return their results in order."""
    spark = df.sparkSession
    context = spark.sparkContext

    def in_pool(name: str, task: Callable[[], object]) -> Callable[[], object]:
        scoped = copy_context()  # what the task stages belongs to the caller's scope

        def run() -> object:
            context.setLocalProperty("spark.scheduler.pool", name)
            return scoped.run(task)

        # wrapped one by one: each has local properties of its own
        return inheritable_thread_target(spark)(run)

    if not tasks:
        return []
    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        return pool.map(lambda run: run(), [in_pool(*item) for item in tasks.items()], chunksize=1)


def group_corpora(
    df: DataFrame,
    group: str,
    no_below: int = vocabulary.NO_BELOW,
    no_above: float = vocabulary.NO_ABOVE,
    keep_n: int = vocabulary.KEEP_N,
) -> dict[object, topics.Corpus]:
    """A corpus per value of ``group`` from ``(id, <group>, tokens)``.

    Whatever the number of groups, the tokens are read three times: once to write them by
    group, once to count all vocabularies, once to make all vectors, each group's own files
    with its own vocabulary. Groups without a term are left out.
    """
    staged = stage(df.select("id", group, "tokens"), "groups", partition_by=group)
    found = {
        g: known
        for g, known in vocabulary.group_vocabularies(staged, group, no_below, no_above, keep_n).items()
        if known[0]
    }
    if not found:
        return {}
    vectors = [vocabulary.vectorize(staged.where(F.col(group) == g), terms) for g, (terms, _) in found.items()]
    table = stage(reduce(DataFrame.unionByName, vectors).select("id", "tokens", "features", group), "vectors", partition_by=group)
    return {
        g: topics.Corpus(table.where(F.col(group) == g).drop(group), terms, n) for g, (terms, n) in sorted(found.items())
    }


def lda_by_decade(
    df: DataFrame,
    decades: Sequence[int] = DECADES,
    k: int = topics.N_TOPICS,
    grid: bool = False,
    no_below: int = vocabulary.NO_BELOW,
    no_above: float = vocabulary.NO_ABOVE,
    keep_n: int = vocabulary.KEEP_N,
    parallelism: int = PARALLELISM,
    **training: int,
) -> list[DecadeRun]:
    """One model per decade from ``(id, decade, tokens)``; decades without songs or terms are skipped.

    Vocabularies are filtered by the documents of each decade. ``parallelism`` decades are
    fitted at a time.
    """
    wanted = df.select("id", "decade", "tokens").where(F.col("decade").isin(*decades))
    corpora = group_corpora(wanted, "decade", no_below, no_above, keep_n)
    if not corpora:
        raise ValueError(f"no songs in the decades {list(decades)}")

    def fit(decade: int) -> DecadeRun:
        corpus, results = corpora[decade], None
        if grid:
            results, models = topics.lda_grid_search(corpus, range(2, k + 1), **training)
            fitted = topics.best_model(results, models)
        else:
            fitted = topics.lda_fit(corpus, k, **training)
        return DecadeRun(decade, corpus, fitted, results)

    present = [d for d in decades if d in corpora]
    return in_pools(df, {f"decade-{d}": lambda d=d: fit(d) for d in present}, parallelism)


def decade_topic_terms(runs: Sequence[DecadeRun], n_terms: int = 10) -> DataFrame:
    """``(decade, topic, rank, term, weight)`` of all runs."""
    parts = [topics.lda_topic_terms(run.fitted, n_terms).withColumn("decade", F.lit(run.decade)) for run in runs]
    return reduce(DataFrame.unionByName, parts).select("decade", "topic", "rank", "term", "weight")


def lda_metrics_by_decade(
    runs: Sequence[DecadeRun], top_words: int = 20, parallelism: int = PARALLELISM
) -> DataFrame:
    """``(decade, coherence, perplexity)``."""
    texts = [run.corpus.documents.select("id", "tokens", F.lit(run.decade).alias("decade")) for run in runs]
    # one pass scores the topics of all decades, each on its own texts
    topic_words = decade_topic_terms(runs, top_words).withColumn("topic", F.struct("decade", "topic"))
    scores = (
        topic_coherence(reduce(DataFrame.unionByName, texts), topic_words, within="decade", top_words=top_words)
        .groupBy(F.col("topic.decade").alias("decade"))
        .agg(F.avg("coherence").alias("coherence"))
    )
    first = runs[0].corpus.documents
    measured = in_pools(
        first,
        {f"decade-{r.decade}": lambda r=r: topics.lda_perplexity(r.fitted, r.corpus.documents) for r in runs},
        parallelism,
    )
    bounds = [(run.decade, bound) for run, bound in zip(runs, measured)]
    return scores.join(first.sparkSession.createDataFrame(bounds, "decade int, perplexity double"), "decade")


def topics_for_genre_decade(
    df: DataFrame,
    genre: str,
    decade: int | str,
    k: int = 10,
    passes: int = 15,
    n_terms: int = 10,
    min_count: float = 1,
    threshold: float = 2.0,
    no_below: int = vocabulary.NO_BELOW,
    no_above: float = vocabulary.NO_ABOVE,
    keep_n: int = vocabulary.KEEP_N,
    **training: int,
) -> DataFrame:
    """Topic terms of one genre and decade, with learned phrases as terms, by a filtered vocabulary."""
    songs = stage(phrase_tokens(filter_genre_decade(df, genre, decade)).select("id", "tokens"), "genre-songs")
    merged = stage(phrases.apply_phrases(songs, phrases.learn_phrases(songs, min_count, threshold)), "genre-phrases")
    terms = vocabulary.filter_vocabulary(vocabulary.build_vocabulary(merged), merged.count(), no_below, no_above, keep_n)
    corpus = topics.make_corpus(merged, terms)
    return topics.lda_topic_terms(topics.lda_fit(corpus, k, passes, **training), n_terms)
