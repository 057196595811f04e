from __future__ import annotations

import math
import threading
from collections import Counter, defaultdict
from datetime import datetime
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from registry import models
from registry.base import content_words
from tests.conftest import rows
from versemill.operators import embeddings, ngrams, phrases, topic_bound, topic_matrix, topic_views, topics, vocabulary
from versemill.operators.coherence import coherence_cv, topic_coherence
from versemill.operators.topic_bound import digamma
from versemill.plans import topic_runs
from versemill.staging import new_path, stage

SF = "/root/testdata/sf0.001"


# --- formulas against plain Python -----------------------------------------------------


def brute_cv(texts, topic_words, window, eps=1e-12):
    counts, total = Counter(), 0
    vocabulary_set = {w for ws in topic_words for w in ws}
    for tokens in texts:
        for start in range(max(1, len(tokens) - window + 1)):
            present = vocabulary_set & set(tokens[start : start + window])
            total += 1
            counts.update((w,) for w in present)
            counts.update(frozenset(p) for p in combinations(sorted(present), 2))
    scores = []
    for ws in topic_words:
        def npmi(a, b):
            pa, pb = counts[(a,)] / total, counts[(b,)] / total
            if pa == 0 or pb == 0:
                return 0.0
            pab = pa if a == b else counts[frozenset((a, b))] / total
            return math.log((pab + eps) / (pa * pb)) / -math.log(pab + eps)

        v = np.array([[npmi(a, b) for b in ws] for a in ws])
        s = v.sum(axis=0)
        norms = np.linalg.norm(v, axis=1) * np.linalg.norm(s)
        scores.append(np.mean([x @ s / n if n else 0.0 for x, n in zip(v, norms)]))
    return scores


@pytest.mark.parametrize("window", [1, 3, 5, 110])
def test_coherence_equals_brute_force(spark, window):
    rng = np.random.default_rng(window)
    texts = [list(rng.choice(list("abcdefgh"), size=n)) for n in (0, 1, 4, 5, 6, 30, 150, 3)]
    topic_words = [["a", "b", "c"], ["d", "a", "zzz", "e"], ["yyy"]]
    df = spark.createDataFrame([(i, [str(t) for t in ts]) for i, ts in enumerate(texts)], "id int, tokens array<string>")
    terms = spark.createDataFrame(
        [(t, r, w) for t, ws in enumerate(topic_words) for r, w in enumerate(ws, 1)], "topic int, rank int, term string"
    )
    got = dict(rows(topic_coherence(df, terms, window=window)))
    assert [got[t] for t in range(3)] == pytest.approx(brute_cv(texts, topic_words, window), abs=1e-9)
    mean = coherence_cv(df, terms, window=window).first()[0]
    assert mean == pytest.approx(np.mean(list(got.values())))


def test_coherence_within_groups(spark):
    texts = [("x", list("abcab")), ("x", list("bbc")), ("y", list("acacb")), ("y", list("ab"))]
    df = spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate(texts)], "id int, g string, tokens array<string>")
    terms = spark.createDataFrame([(g, r, w) for g in "xy" for r, w in enumerate("abc", 1)], "g string, rank int, term string")
    both = topic_coherence(df, terms.withColumn("topic", F.col("g")), within="g", window=2)
    for g, score in rows(both):
        assert score == pytest.approx(brute_cv([t for h, t in texts if h == g], [list("abc")], 2)[0])


def test_too_many_topic_words(spark):
    with pytest.raises(ValueError):
        topic_coherence(spark.range(1), spark.range(1), top_words=63)


DOCS = [list("abcab"), list("ab"), [], list("bca"), list("aab"), ["c"]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "id int, tokens array<string>")


def plain_counts(n):
    return Counter(tuple(d[i : i + n]) for d in DOCS for i in range(len(d) - n + 1))


@pytest.mark.parametrize("n", [2, 3])
def test_pmi_formula_and_document_borders(docs, n):
    words, grams = plain_counts(1), plain_counts(n)
    total = sum(words.values())
    expected = {
        g: (c, math.log2(c * total ** (n - 1) / math.prod(words[(w,)] for w in g))) for g, c in grams.items() if c >= 2
    }
    found = (ngrams.bigram_pmi if n == 2 else ngrams.trigram_pmi)(docs, min_count=2).collect()
    got = {tuple(r[:n]): (r["n"], pytest.approx(r.pmi)) for r in found}
    assert got == expected and expected


def test_phrase_scores(docs):
    words, grams = plain_counts(1), plain_counts(2)
    entries = len(words) + len(grams)
    expected = {
        g: (c - 1) * entries / (words[(g[0],)] * words[(g[1],)]) for g, c in grams.items() if c > 1
    }
    got = {(r.w1, r.w2): pytest.approx(r.score) for r in phrases.learn_phrases(docs, 1, 0.0).collect()}
    assert got == expected and expected


def test_filter_rules(spark):
    data = [("aaa", "b", 60, 9.0), ("aa", "bb", 60, 8.0), ("the", "bbb", 60, 7.0), ("n", "bbb", 60, 7.0), ("ccc", "ddd", 60, 5.0), ("vvv", "www", 60, 6.0)]
    grams = spark.createDataFrame(data, "w1 string, w2 string, n long, pmi double")
    tags = spark.createDataFrame([("vvv", "VBG"), ("www", "RB")], "word string, tag string")
    assert rows(ngrams.filter_bigrams(grams, tags, ["the"]), "phrase") == [("aaa b",)]
    # the cut comes before the length test
    assert rows(ngrams.filter_bigrams(grams.where("w1 <> 'aaa'"), tags, ["the"], top=1), "phrase") == []
    three = spark.createDataFrame([("aa", "bbb", "ccc", 60, 9.0), ("aa", "bbb", "c", 60, 9.0), ("aaa", "b", "c", 60, 9.0)], "w1 string, w2 string, w3 string, n long, pmi double")
    assert rows(ngrams.filter_trigrams(three, tags, []), "phrase") == [("aa bbb ccc",), ("aaa b c",)]


def test_join_ngrams_in_order(spark):
    df = spark.createDataFrame([("new york city", ), ("in new york", ), (None,)], "x string")
    joined = df.select(ngrams.join_ngrams_in_text(F.col("x"), ["new york city", "new york", "york city"]).alias("x"))
    assert [r.x for r in joined.collect()] == ["new_york_city", "in new_york", None]
    assert df.select(ngrams.join_ngrams_in_text(F.col("x"), [])).count() == 3


# --- topic models ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    df = stage(content_words(spark, SF).select("id", "tokens"), "content")
    terms = vocabulary.filter_vocabulary(vocabulary.build_vocabulary(df), df.count(), no_below=5)
    return topics.make_corpus(df, terms)


@pytest.fixture(scope="module")
def fitted(corpus):
    return topics.lda_fit(corpus, k=3, passes=3)


def test_priors():
    assert topics.document_prior("symmetric", 4) == [0.25] * 4
    asymmetric = topics.document_prior("asymmetric", 4)
    assert sum(asymmetric) == pytest.approx(1) and asymmetric == sorted(asymmetric, reverse=True)
    assert asymmetric[1] / asymmetric[0] == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        topics.document_prior("other", 4)


def test_document_topics(corpus, fitted):
    weights = defaultdict(dict)
    for i, topic, weight in rows(topics.lda_doc_topics(fitted, corpus.documents)):
        weights[i][topic] = weight
    assert len(weights) == corpus.n_docs
    assert all(len(w) == 3 and min(w.values()) >= 0 and sum(w.values()) == pytest.approx(1) for w in weights.values() if sum(w.values()))
    for i, topic, weight in rows(topics.lda_dominant_topic(fitted, corpus.documents)):
        assert weight == max(weights[i].values()) == weights[i][topic]


def test_topic_terms(corpus, fitted):
    got = rows(topics.lda_topic_terms(fitted, 8))
    assert [(t, r) for t, r, _, _ in got] == [(t, r) for t in range(3) for r in range(1, 9)]
    assert {term for _, _, term, _ in got} <= set(corpus.terms)
    assert all(a[3] >= b[3] for a, b in zip(got, got[1:]) if a[0] == b[0])


def test_same_seed_same_model_and_bound_sign(corpus, fitted):
    bound = topics.lda_perplexity(fitted, corpus.documents)
    assert bound < 0
    assert bound == pytest.approx(-fitted.model.logPerplexity(corpus.documents), rel=1e-6)
    likelihood = topics.lda_log_likelihood(fitted, corpus.documents)
    assert likelihood == pytest.approx(fitted.model.logLikelihood(corpus.documents), rel=1e-6)
    again = topics.lda_fit(corpus, k=3, passes=3)
    assert topics.lda_perplexity(again, corpus.documents) == pytest.approx(bound, rel=1e-6)


@pytest.mark.parametrize("pieces,width", [(200_000, 1024), (7, 5), (1, 64)])
def test_bound_without_broadcast(corpus, fitted, monkeypatch, pieces, width):
    want = topic_bound.likelihood_bound(fitted.model, corpus.documents)
    monkeypatch.setattr(topic_bound, "PIECES", pieces)
    monkeypatch.setattr(topic_bound, "BLOCK_TERMS", width)

    def forbidden(*_):
        raise AssertionError("broadcast")

    monkeypatch.setattr(topic_bound, "_by_broadcast", forbidden)
    got = topic_bound.likelihood_bound(fitted.model, corpus.documents.repartition(3), max_bytes=0)
    assert got == pytest.approx(want, rel=1e-9)


def test_matrix_is_a_written_table_of_blocks(corpus, fitted, monkeypatch):
    monkeypatch.setattr(topic_matrix, "SLAB", 100)
    blocks = topic_matrix.write_blocks(corpus.documents.sparkSession, topics.term_probabilities(fitted), fitted.terms, 16)
    got = sorted((r.block, r.terms, r.weights) for r in blocks.collect())
    assert [t for _, terms, _ in got for t in terms] == list(corpus.terms)
    assert np.array([w for _, _, ws in got for w in ws]).reshape(-1, 3) == pytest.approx(topics.term_probabilities(fitted))
    for made in (
        topic_views.topic_term_relevance(fitted, corpus.documents, 5, blocks=blocks),
        topic_views.topic_distance(blocks, 3),
    ):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "LocalRelation" not in plan and "LogicalRDD" not in plan
    # the words of a model are its k x n best ones
    assert topics.lda_topic_terms(fitted, 8).count() == 24
    described = fitted.model.describeTopics(8).collect()
    got = {(r.topic, r.rank): (r.term, r.weight) for r in topics.lda_topic_terms(fitted, 8).collect()}
    for row in described:
        for rank, (i, w) in enumerate(zip(row.termIndices, row.termWeights), 1):
            assert got[row.topic, rank] == (corpus.terms[i], pytest.approx(w))


def test_relevance_of_given_probabilities(spark):
    given = [(0, "a", 0.5), (0, "b", 0.5), (1, "a", 0.25), (1, "c", 0.5), (1, "é", 0.25), (0, "z", 0.0)]
    blocks = topic_matrix.blocks_of(spark.createDataFrame(given, "topic int, term string, p double"), 2)
    got = rows(topic_matrix.relevant_terms(blocks.repartition(3), [0.5, 0.5], 2, 0.0))
    assert [(t, r, w, round(v, 6)) for t, r, w, v in got] == [
        (0, 1, "b", round(math.log(2), 6)), (0, 2, "a", round(math.log(4 / 3), 6)),
        (1, 1, "c", round(math.log(2), 6)), (1, 2, "é", round(math.log(2), 6)),
    ]
    assert rows(topic_matrix.long_form(blocks, 2).where("p > 0")) == sorted(g for g in given if g[2])


def test_covariance_and_axes(spark, corpus, fitted):
    generator = np.random.default_rng(1)
    x = generator.random((50, 3)) @ np.diag([3, 1, 0.2])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "theta array<double>").repartition(4)
    got = topic_views.topic_covariance(df, 3)
    want = np.cov(x.T)
    assert [r[2] for r in rows(got)] == pytest.approx([want[i, j] for i in range(3) for j in range(i, 3)])
    axes = topic_views.principal_axes(got, 3, 2)
    values, vectors = np.linalg.eigh(want)
    assert np.abs(axes.T @ vectors[:, ::-1][:, :2]) == pytest.approx(np.eye(2), abs=1e-9)
    weights = {r.id: r.theta for r in topics.topic_distribution(fitted, corpus.documents).collect()}
    made = topic_views.project_doc_topics(fitted, corpus.documents, 2)
    axes = topic_views.principal_axes(topic_views.topic_covariance(topics.topic_distribution(fitted, corpus.documents), 3), 3, 2)
    for row in made.collect():
        assert (row.x, row.y) == pytest.approx(tuple(np.array(weights[row.id]) @ axes))
    assert "mapPartitions" not in made._jdf.queryExecution().executedPlan().toString()


def test_digamma():
    x = np.array([0.01, 0.5, 1.0, 2.5, 7.0, 100.0])
    step = 1e-6 * x
    slope = [(math.lgamma(a + h) - math.lgamma(a - h)) / (2 * h) for a, h in zip(x, step)]
    assert digamma(x) == pytest.approx(slope, rel=1e-6)


def test_bound_is_the_same_in_small_parts(corpus, fitted, monkeypatch):
    bound = topics.lda_perplexity(fitted, corpus.documents)
    monkeypatch.setattr(topic_bound, "CELLS", 1000)
    assert topics.lda_perplexity(fitted, corpus.documents.repartition(3)) == pytest.approx(bound, rel=1e-9)


def test_terms_with_line_breaks(spark):
    df = spark.createDataFrame([(1, ["a\nb", "c", "c"])], "id int, tokens array<string>")
    for terms in (["a\nb", "c"], ["c", "d"]):
        vector = vocabulary.vectorize(df, terms).first().features
        assert vector.size == 2 and vector[terms.index("c")] == 2


def test_auto_settings(corpus):
    assert topics.lda_fit(corpus, k=2, passes=1, alpha="auto", eta="auto").k == 2
    with pytest.raises(ValueError):
        topics.lda_fit(corpus, k=2, eta="other")


def test_save_and_load(spark, corpus, fitted):
    path = topics.save_topic_model(fitted, new_path(spark, "models"), 0.4, datetime(2024, 2, 1, 3, 4, 5))
    assert path.endswith("/01022024_030405")
    again, coherence = topics.load_topic_model(path)
    assert coherence == 0.4 and again.k == 3 and list(again.terms) == list(fitted.terms)
    assert rows(topics.lda_topic_terms(again)) == rows(topics.lda_topic_terms(fitted))


def test_grid_and_best_model(corpus):
    results, models = topics.lda_grid_search(corpus, range(2, 4), passes=1)
    got = results.orderBy("model").collect()
    assert [(r.topics, r.alpha, r.eta) for r in got] == [
        (k, a, "symmetric") for k in (2, 3) for a in ("symmetric", "asymmetric")
    ]
    best = topics.best_model(results, models)
    assert max(r.coherence for r in got) == next(r.coherence for r in got if models[r.model] is best)
    again, _ = topics.lda_grid_search(corpus, range(2, 4), passes=1, parallelism=2)
    assert [r.coherence for r in again.orderBy("model").collect()] == pytest.approx([r.coherence for r in got])
    # scoring all models in one pass equals scoring one alone
    alone = coherence_cv(corpus.documents, topics.lda_topic_terms(models[1], 20)).first()[0]
    assert alone == pytest.approx(got[1].coherence)


def test_grid_query_runs_the_whole_grid(spark, monkeypatch):
    asked = []

    def grid(data, ks, alphas=("symmetric", "asymmetric"), etas=("symmetric",), **training):
        asked.extend((k, a, e, training["passes"]) for k in ks for a in alphas for e in etas)
        return spark.range(1), []

    monkeypatch.setattr(models, "corpus", lambda *_: None)
    monkeypatch.setattr(topics, "lda_grid_search", grid)
    queries()["lda_grid_search"](spark, SF)
    assert asked == [(k, a, "symmetric", 10) for k in range(2, 11) for a in ("symmetric", "asymmetric")]


def test_fits_of_a_grid_share_the_cores_and_read_no_cached_frame(corpus, monkeypatch):
    alone = topics.lda_fit(corpus, k=2, passes=1)
    levels, running, most = [], set(), []

    class Watched(topics.LDA):
        def fit(self, dataset):
            running.add(id(self))
            most.append(len(running))
            levels.append(dataset.storageLevel)
            started.wait(60)
            try:
                return super().fit(dataset)
            finally:
                running.discard(id(self))

    started = threading.Barrier(2)
    monkeypatch.setattr(topics, "LDA", Watched)
    _, fitted = topics.lda_grid_search(corpus, [2], passes=1)
    assert max(most) == 2
    assert all(not (level.useMemory or level.useDisk) for level in levels)
    assert fitted[0].model.topicsMatrix() == alone.model.topicsMatrix()


def test_fits_that_do_not_fit_in_memory_run_one_by_one(corpus):
    assert topics.fits_at_once(corpus) == topics.FITS_AT_ONCE
    assert topics.fits_at_once(topics.Corpus(corpus.documents, corpus.terms, 10**15)) == 1


def test_empty_vocabulary(spark, corpus):
    none = vocabulary.build_vocabulary(corpus.documents.limit(0))
    with pytest.raises(ValueError):
        topics.make_corpus(corpus.documents, none)


def test_views(corpus, fitted):
    share = dict(rows(topic_views.topic_share(fitted, corpus.documents)))
    assert sum(share.values()) == pytest.approx(1)
    matrix = defaultdict(dict)
    for topic, term, p in rows(topic_views.topic_term_probabilities(fitted)):
        matrix[term][topic] = p
    p = np.array([[matrix[t][k] for t in corpus.terms] for k in range(3)])
    assert p.sum(axis=1) == pytest.approx(1)

    marginal = np.array([share[k] for k in range(3)]) @ p
    relevance = 0.6 * np.log(p) + 0.4 * np.log(p / marginal)
    for topic, rank, term, value in rows(topic_views.topic_term_relevance(fitted, corpus.documents, 5)):
        order = sorted(range(len(corpus.terms)), key=lambda i: (-relevance[topic, i], corpus.terms[i]))
        assert value == pytest.approx(relevance[topic, order[rank - 1]])

    distances = rows(topic_views.topic_distance(topic_views.topic_term_probabilities(fitted), 3))
    assert [d[:2] for d in distances] == [(0, 1), (0, 2), (1, 2)]
    for a, b, distance in distances:
        m = (p[a] + p[b]) / 2
        expected = math.sqrt((np.sum(p[a] * np.log(p[a] / m)) + np.sum(p[b] * np.log(p[b] / m))) / 2)
        assert distance == pytest.approx(expected)


def test_projection(corpus, fitted):
    assert topic_views.project_doc_topics(fitted, corpus.documents, 3).columns == ["id", "topic", "x", "y", "z"]
    assert topic_views.project_doc_topics(fitted, corpus.documents).count() == corpus.n_docs
    with pytest.raises(ValueError):
        topic_views.project_doc_topics(fitted, corpus.documents, 4)


def test_models_per_decade(spark):
    df = stage(content_words(spark, SF).select("id", "decade", "tokens"), "content")
    runs = topic_runs.lda_by_decade(df, [1970, 1990, 1850], k=2, no_below=3, passes=1)
    assert [r.decade for r in runs] == [1970, 1990]
    for run in runs:
        songs = df.where(F.col("decade") == run.decade)
        alone = vocabulary.filter_vocabulary(vocabulary.build_vocabulary(songs), songs.count(), no_below=3)
        assert list(run.corpus.terms) == vocabulary.vocabulary_terms(alone) and run.corpus.n_docs == songs.count()
        counted = run.corpus.documents.select("id", "features").collect()
        want = {r.id: Counter(r.tokens) for r in songs.collect()}
        for r in counted:
            got = {run.corpus.terms[i]: n for i, n in zip(r.features.indices, r.features.values)}
            assert got == {t: n for t, n in want[r.id].items() if t in set(run.corpus.terms)}
    metrics = rows(topic_runs.lda_metrics_by_decade(runs))
    for run, (decade, coherence, bound) in zip(runs, metrics):
        alone = coherence_cv(run.corpus.documents, topics.lda_topic_terms(run.fitted, 20)).first()[0]
        assert decade == run.decade and coherence == pytest.approx(alone) and bound < 0
    with pytest.raises(ValueError):
        topic_runs.lda_by_decade(df, [1850])


def test_vocabulary_cut_of_groups(spark):
    lists = [["a", "b"], ["a", "c"], ["a", "b", "b"], ["d"], ["d", "a"], ["d", "b"], []]
    df = spark.createDataFrame([(k, k % 2 if k < 6 else 5, t) for k, t in enumerate(lists)], "id int, g int, tokens array<string>")
    for no_below, no_above, keep_n in ((1, 1.0, 10), (2, 1.0, 10), (1, 0.7, 10), (1, 1.0, 1), (2, 1.0, 2)):
        found = vocabulary.group_vocabularies(df, "g", no_below, no_above, keep_n)
        for g in (0, 1, 5):
            part = df.where(F.col("g") == g)
            alone = vocabulary.filter_vocabulary(vocabulary.build_vocabulary(part), part.count(), no_below, no_above, keep_n)
            assert found[g] == (vocabulary.vocabulary_terms(alone), part.count())
    with pytest.raises(ValueError):
        vocabulary.group_vocabularies(df, "g", 1, 1.0, max_terms=2)


def test_scans_do_not_grow_with_the_groups(spark, monkeypatch):
    labels = []

    def counted(df, label, partition_by=None):
        labels.append(label)
        return stage(df, label, partition_by)

    for module in (topic_runs, vocabulary):
        monkeypatch.setattr(module, "stage", counted)
    counts = []
    for groups in (2, 6):
        df = spark.range(60).select("id", (F.col("id") % groups).alias("g"), F.array(F.lit("a"), F.lit("b")).alias("tokens"))
        labels.clear()
        assert len(topic_runs.group_corpora(df, "g", no_below=1, no_above=1.0)) == groups
        counts.append(len(labels))
    assert counts == [3, 3]


def test_jobs_in_pools(spark):
    pools = topic_runs.in_pools(
        spark.range(1), {f"p{i}": lambda i=i: (i, spark.sparkContext.getLocalProperty("spark.scheduler.pool")) for i in range(5)}, 3
    )
    assert pools == [(i, f"p{i}") for i in range(5)]
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_embedding_topics(spark):
    data = [(i, ["sun", "sky", "blue"] if i % 2 else ["night", "moon", "dark"]) for i in range(40)] + [(99, ["rare"])]
    df = spark.createDataFrame(data, "id int, tokens array<string>")
    vectors, words = embeddings.embed_documents(df, size=8, min_count=5)
    found = embeddings.embed_topics_fit(vectors, (2, 3), words)
    assert found.num_topics in (2, 3) and found.documents.count() == 41
    assert rows(found.documents.where("id = 99"), "topic") == [(embeddings.NO_TOPIC,)]
    sizes = embeddings.embed_topic_sizes(found).collect()
    assert [r.n for r in sizes] == sorted((r.n for r in sizes), reverse=True) and sum(r.n for r in sizes) == 41
    near = rows(embeddings.embed_topic_words(found, 3))
    assert all(-1.0001 <= score <= 1.0001 for _, _, _, score in near)
    path = new_path(spark, "embedding-topics")
    embeddings.save_embedding_topics(found, path)
    again = embeddings.load_embedding_topics(spark, path)
    assert rows(embeddings.embed_topic_words(again, 3)) == near


def test_search_by_topic(spark):
    data = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0]), (4, [2.0, 0.0]), (5, [0.0, 0.0]), (6, None)]
    df = spark.createDataFrame(data, "vec_id int, embedding array<double>").repartition(3)
    got = embeddings.search_documents_by_topic(df, [[1.0, 0.0], [0.0, 3.0]], 3)
    assert [(t, i, round(s, 4)) for t, i, s in sorted(map(tuple, got.collect()), key=lambda r: (r[0], -r[2], r[1]))] == [
        (0, 1, 1.0), (0, 4, 1.0), (0, 2, 0.7071), (1, 3, 1.0), (1, 2, 0.7071), (1, 1, 0.0),
    ]
    named = df.withColumn("label", F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd"))
    got = embeddings.search_documents_by_topic(named, {"odd": [1.0, 0.0], "even": [1.0, 0.0]}, 1, label="label", digits=6)
    assert rows(got) == [("even", 4, 1.0), ("odd", 1, 1.0)]
    assert embeddings.search_documents_by_topic(df.where("vec_id > 4"), [[1.0, 0.0]]).count() == 0


def test_search_shuffles_no_vector(spark):
    generator = np.random.default_rng(2)
    x = generator.normal(size=(400, 6)).round(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id int, embedding array<float>").repartition(5)
    centres = generator.normal(size=(4, 6))
    found = embeddings.search_documents_by_topic(df, centres, 7)
    x32 = x.astype(np.float32).astype(float)
    cosines = (x32 @ centres.T) / np.linalg.norm(x32, axis=1)[:, None] / np.linalg.norm(centres, axis=1)
    want = sorted((t, i) for t in range(4) for i in sorted(range(400), key=lambda i: (-cosines[i, t], i))[:7])
    assert rows(found, "topic", "vec_id") == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hash" in line]
    assert exchanges and plan.index("MapInArrow") > plan.index("Exchange hash")
