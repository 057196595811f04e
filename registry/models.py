"""Topic models, coherence, dashboard tables and embedding topics."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from registry.base import content_words, cte, query, songs, with_ctes
from registry.tables import decade_songs
from versemill.functions import text
from versemill.operators import embeddings, topic_matrix, topic_views, topics, vocabulary
from versemill.operators.coherence import EPSILON, WINDOW, coherence_cv
from versemill.operators.topic_bound import likelihood_bound
from versemill.operators.unnest import unnest
from versemill.plans import topic_runs
from versemill.plans.corpus import pluggable_preprocess
from versemill.sources.songs import read_spread
from versemill.staging import new_path, stage

K, PASSES = 5, 5

# the grid of the original: 2 to 10 topics with each prior, 18 fits of 10 passes
GRID_KS, GRID_PASSES = range(2, topics.N_TOPICS + 1), 10


# a vocabulary cut that suits small corpora too: in at least three texts
NO_BELOW = 3


def corpus(spark, sf):
    df = stage(content_words(spark, sf).select("id", "tokens"), "content")
    terms = vocabulary.filter_vocabulary(vocabulary.build_vocabulary(df), df.count(), no_below=NO_BELOW)
    return topics.make_corpus(df, terms)


def fitted(spark, sf, **settings):
    data = corpus(spark, sf)
    return data, topics.lda_fit(data, **{"k": K, "passes": PASSES, **settings})


def metrics_row(spark, data, model):
    scores = coherence_cv(data.documents, topics.lda_topic_terms(model, 20))
    return scores.select(
        F.lit(model.k).alias("k"),
        "coherence",
        F.lit(topics.lda_perplexity(model, data.documents)).alias("bound"),
    )


# --- coherence with given topic words --------------------------------------------------

N_FIXED, FIXED_TOPICS = 60, 3
cte(
    "fixed_topics",
    "SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY term) AS INTEGER) AS rank, term FROM"
    f" (SELECT CAST((row_number() OVER (ORDER BY count(*) DESC, term) - 1) % {FIXED_TOPICS} AS INTEGER) AS topic, term"
    " FROM (SELECT unnest(tokens) AS term FROM content) GROUP BY term"
    f" ORDER BY count(*) DESC, term LIMIT {N_FIXED})",
    "content",
)


def fixed_topics(df):
    """The most frequent words, dealt out to topics."""
    ranked = Window.orderBy(F.desc("n"), "term")
    in_topic = Window.partitionBy("topic").orderBy("term")
    counts = unnest(df, "tokens", "term").groupBy("term").agg(F.count("*").alias("n"))
    return (
        counts.orderBy(F.desc("n"), "term")
        .limit(N_FIXED)
        .select(((F.row_number().over(ranked) - 1) % FIXED_TOPICS).cast("int").alias("topic"), "term")
        .select("topic", F.row_number().over(in_topic).alias("rank"), "term")
    )


# brute force: every window of every text, every word in it
cte(
    "cv_texts",
    f"SELECT id, tokens, CAST(len(tokens) AS BIGINT) AS len, greatest(len(tokens) - {WINDOW - 1}, 1) AS windows FROM content",
    "content",
)
cte("cv_total", "SELECT CAST(sum(windows) AS DOUBLE) AS total FROM cv_texts", "cv_texts")
cte(
    "cv_hits",
    "SELECT DISTINCT id, term, unnest(generate_series(greatest(pos - " + str(WINDOW - 1) + ", 0),"
    f" least(pos, greatest(len - {WINDOW}, 0)))) AS win FROM"
    " (SELECT id, len, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM cv_texts)"
    " WHERE term IN (SELECT term FROM fixed_topics)",
    "cv_texts",
    "fixed_topics",
)
cte("cv_single", "SELECT term, count(*) / total AS p FROM cv_hits, cv_total GROUP BY term, total", "cv_hits", "cv_total")
cte(
    "cv_pairs",
    "SELECT x.topic, x.term AS a, y.term AS b, count(*) AS n FROM cv_hits h JOIN fixed_topics x ON x.term = h.term"
    " JOIN cv_hits g ON g.id = h.id AND g.win = h.win JOIN fixed_topics y ON y.term = g.term AND y.topic = x.topic"
    " GROUP BY ALL",
    "cv_hits",
    "fixed_topics",
)
cte(
    "cv_npmi",
    f"SELECT x.topic, x.term AS a, y.term AS b, ln((coalesce(n, 0) / total + {EPSILON}) / (pa.p * pb.p))"
    f" / -ln(coalesce(n, 0) / total + {EPSILON}) AS v FROM fixed_topics x JOIN fixed_topics y USING (topic)"
    " LEFT JOIN cv_pairs c ON c.topic = x.topic AND c.a = x.term AND c.b = y.term"
    " JOIN cv_single pa ON pa.term = x.term JOIN cv_single pb ON pb.term = y.term, cv_total",
    "cv_pairs",
    "cv_single",
    "cv_total",
)
cte("cv_sums", "SELECT topic, b, sum(v) AS s FROM cv_npmi GROUP BY topic, b", "cv_npmi")


@query(
    "coherence_cv",
    with_ctes(
        "SELECT round(avg(c), 6) AS coherence FROM (SELECT topic, avg(cosine) AS c FROM"
        " (SELECT topic, a, sum(v * s) / (sqrt(sum(v * v)) * sqrt(sum(s * s))) AS cosine"
        " FROM cv_npmi JOIN cv_sums USING (topic, b) GROUP BY topic, a) GROUP BY topic)",
        "cv_npmi",
        "cv_sums",
    ),
)
def _(spark, sf):
    df = stage(content_words(spark, sf).select("id", "tokens"), "content")
    return coherence_cv(df, fixed_topics(df)).withColumn("coherence", F.round("coherence", 6))


# --- LDA -------------------------------------------------------------------------------


@query("lda_fit")
def _(spark, sf):
    data, model = fitted(spark, sf, alpha="auto")
    return metrics_row(spark, data, model)


@query("lda_topic_terms")
def _(spark, sf):
    return topics.lda_topic_terms(fitted(spark, sf)[1], 15)


@query("lda_doc_topics")
def _(spark, sf):
    data, model = fitted(spark, sf)
    return topics.lda_doc_topics(model, data.documents)


@query("lda_dominant_topic")
def _(spark, sf):
    data, model = fitted(spark, sf)
    return topics.lda_dominant_topic(model, data.documents)


@query("lda_perplexity")
def _(spark, sf):
    data, model = fitted(spark, sf)
    total, tokens = likelihood_bound(model.model, data.documents)
    return spark.createDataFrame([(total / tokens, total, int(tokens))], "bound double, log_likelihood double, tokens long")


@query("lda_sweep_k")
def _(spark, sf):
    results, _models = topics.lda_sweep_k(corpus(spark, sf), (3, 5, 7), alpha="auto", passes=PASSES)
    return results


@query("lda_grid_search")
def _(spark, sf):
    results, _models = topics.lda_grid_search(corpus(spark, sf), GRID_KS, passes=GRID_PASSES)
    return results


@query("save_load_topic_model")
def _(spark, sf):
    data, model = fitted(spark, sf)
    path = topics.save_topic_model(model, new_path(spark, "models"), coherence=0.5)
    again, coherence = topics.load_topic_model(path)
    return topics.lda_topic_terms(again).withColumn("coherence", F.lit(coherence))


def decade_runs(spark, sf):
    df = content_words(spark, sf).select("id", "decade", "tokens")
    return topic_runs.lda_by_decade(df, k=3, passes=PASSES, no_below=NO_BELOW)


@query("lda_by_decade")
def _(spark, sf):
    return topic_runs.decade_topic_terms(decade_runs(spark, sf))


@query("lda_metrics_by_decade")
def _(spark, sf):
    return topic_runs.lda_metrics_by_decade(decade_runs(spark, sf))


@query("topics_for_genre_decade")
def _(spark, sf):
    df = decade_songs(spark, sf)
    lyrics = F.coalesce(text.clean_text(F.col("lyrics")), F.lit(""))
    return topic_runs.topics_for_genre_decade(
        df.withColumn("lyrics", lyrics), "rap", "2010", k=3, passes=PASSES, min_count=5, threshold=100.0, no_below=NO_BELOW
    )


# --- dashboard tables ------------------------------------------------------------------


@query("topic_share")
def _(spark, sf):
    data, model = fitted(spark, sf)
    return topic_views.topic_share(model, data.documents)


@query("topic_term_relevance")
def _(spark, sf):
    data, model = fitted(spark, sf)
    return topic_views.topic_term_relevance(model, data.documents, 15)


@query("topic_distance")
def _(spark, sf):
    model = fitted(spark, sf)[1]
    return topic_views.topic_distance(topic_views.topic_blocks(model), K)


@query("project_doc_topics")
def _(spark, sf):
    data, model = fitted(spark, sf)
    return topic_views.project_doc_topics(model, data.documents, 2)


# --- the same formulas on given weights, which SQL can follow --------------------------

# weights of four topics: shares of the words of each length modulo four, smoothed
_GIVEN = ", ".join(f"(len(list_filter(tokens, lambda t: length(t) % 4 = {t})) + 1.0) / (len(tokens) + 4.0)" for t in range(4))
cte(
    "given_weights",
    f"SELECT id, CAST(len(tokens) AS BIGINT) AS length, [{_GIVEN}] AS theta FROM content",
    "content",
)
cte(
    "given_long",
    "SELECT id, length, unnest(range(4)) AS topic, unnest(theta) AS weight FROM given_weights",
    "given_weights",
)


def given_weights(spark, sf):
    tokens, size = F.col("tokens"), F.size("tokens")

    def share(topic):
        fits = F.filter(tokens, lambda t: F.char_length(t) % 4 == topic)
        return (F.size(fits) + 1).cast("double") / (size + 4).cast("double")

    return content_words(spark, sf).select("id", size.cast("long").alias("length"), F.array(*map(share, range(4))).alias("theta"))


@query(
    "topic_share_given",
    with_ctes(
        "SELECT CAST(topic AS INTEGER) AS topic, round(sum(weight * length) / (SELECT sum(weight * length) FROM given_long), 6)"
        " AS share FROM given_long GROUP BY topic",
        "given_long",
    ),
)
def _(spark, sf):
    return topic_views.weighted_share(given_weights(spark, sf)).withColumn("share", F.round("share", 6))


@query(
    "dominant_topic_given",
    with_ctes(
        "SELECT id, CAST(list_position(theta, list_max(theta)) - 1 AS INTEGER) AS topic, round(list_max(theta), 6) AS weight"
        " FROM given_weights",
        "given_weights",
    ),
)
def _(spark, sf):
    return given_weights(spark, sf).select(
        "id", topics.dominant_topic("theta").alias("topic"), F.round(F.array_max("theta"), 6).alias("weight")
    )


@query(
    "topic_covariance_given",
    with_ctes(
        "SELECT CAST(a.topic AS INTEGER) AS i, CAST(b.topic AS INTEGER) AS j, round(covar_samp(a.weight, b.weight), 6) AS covariance"
        " FROM given_long a JOIN given_long b ON a.id = b.id AND a.topic <= b.topic GROUP BY a.topic, b.topic",
        "given_long",
    ),
)
def _(spark, sf):
    found = topic_views.topic_covariance(given_weights(spark, sf), 4)
    return found.withColumn("covariance", F.round("covariance", 6))


# probabilities of the words within each genre, the genres in the order of their names
cte(
    "given_counts",
    "SELECT CAST(dense_rank() OVER (ORDER BY tag) - 1 AS INTEGER) AS topic, term, n FROM"
    " (SELECT tag, term, count(*) AS n FROM (SELECT tag, unnest(tokens) AS term FROM content) GROUP BY ALL)",
    "content",
)
cte(
    "given_p",
    "SELECT topic, term, n / sum(n) OVER (PARTITION BY topic) AS p,"
    " sum(n) OVER (PARTITION BY topic) / sum(n) OVER () AS share FROM given_counts",
    "given_counts",
)
cte("given_term", "SELECT term, sum(p * share) AS p_term FROM given_p GROUP BY term", "given_p")


def given_probabilities(spark, sf):
    """``(topic, term, p)`` and the share of each topic."""
    counts = stage(unnest(content_words(spark, sf), "tokens", "term", "tag").groupBy("tag", "term").count(), "given")
    sizes = {row.tag: row.n for row in counts.groupBy("tag").agg(F.sum("count").alias("n")).orderBy("tag").collect()}
    tag = F.array(*map(F.lit, sizes))
    topic = (F.array_position(tag, F.col("tag")) - 1).cast("int")
    size = F.get(F.array(*map(F.lit, sizes.values())), topic)
    total = sum(sizes.values())
    return counts.select(topic.alias("topic"), "term", (F.col("count") / size).alias("p")), [n / total for n in sizes.values()]


@query(
    "topic_term_relevance_given",
    with_ctes(
        "SELECT topic, CAST(rank AS INTEGER) AS rank, term, round(relevance, 6) AS relevance FROM (SELECT topic, term, relevance,"
        " row_number() OVER (PARTITION BY topic ORDER BY round(relevance, 9) DESC, term) AS rank FROM"
        " (SELECT topic, term, 0.6 * ln(p) + 0.4 * ln(p / p_term) AS relevance FROM given_p JOIN given_term USING (term)))"
        " WHERE rank <= 15",
        "given_p",
        "given_term",
    ),
)
def _(spark, sf):
    p, shares = given_probabilities(spark, sf)
    found = topic_matrix.relevant_terms(topic_matrix.blocks_of(p, len(shares)), shares, 15, 0.6)
    return found.withColumn("relevance", F.round("relevance", 6))


@query(
    "topic_distance_given",
    with_ctes(
        "SELECT topic_a, topic_b, round(sqrt(sum(CASE WHEN pa > 0 THEN pa * ln(2 * pa / (pa + pb)) ELSE 0 END"
        " + CASE WHEN pb > 0 THEN pb * ln(2 * pb / (pa + pb)) ELSE 0 END) / 2), 6) AS distance FROM"
        " (SELECT x.topic AS topic_a, y.topic AS topic_b, t.term, coalesce(a.p, 0) AS pa, coalesce(b.p, 0) AS pb"
        " FROM (SELECT DISTINCT topic FROM given_p) x JOIN (SELECT DISTINCT topic FROM given_p) y ON x.topic < y.topic,"
        " (SELECT DISTINCT term FROM given_p) t LEFT JOIN given_p a ON a.topic = x.topic AND a.term = t.term"
        " LEFT JOIN given_p b ON b.topic = y.topic AND b.term = t.term) GROUP BY topic_a, topic_b",
        "given_p",
    ),
)
def _(spark, sf):
    p, shares = given_probabilities(spark, sf)
    return topic_views.topic_distance(p, len(shares)).withColumn("distance", F.round("distance", 6))


# --- embedding topics ------------------------------------------------------------------


def embedding_topics(spark, sf):
    df = pluggable_preprocess(
        songs(spark, sf).where("lyrics IS NOT NULL"),
        lambda lyrics: text.tokenize_simple(text.clean_text_compact(lyrics)),
    )
    df = stage(df.select("id", "tokens"), "embedding-tokens")
    vectors, words = embeddings.embed_documents(df, size=32, min_count=20)
    return embeddings.embed_topics_fit(vectors, (4, 6, 8), words)


@query("embed_topics_fit")
def _(spark, sf):
    vectors = read_spread(spark, f"{sf}/embeddings.parquet").select(
        "vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("vector")
    )
    found = embeddings.embed_topics_fit(vectors, (5, 10), key="vec_id")
    return found.documents.select("vec_id", "topic", F.lit(found.num_topics).alias("num_topics"))


@query("embed_topic_sizes")
def _(spark, sf):
    return embeddings.embed_topic_sizes(embedding_topics(spark, sf))


@query("embed_topic_words")
def _(spark, sf):
    return embeddings.embed_topic_words(embedding_topics(spark, sf), 20)


_EMBEDDING = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
cte(
    "centroids",
    "SELECT label, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(x) AS m FROM (SELECT label,"
    " unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label",
)


@query(
    "search_documents_by_topic",
    with_ctes(
        f"SELECT e.label, vec_id, round(list_cosine_similarity({_EMBEDDING}, centre), 6) AS score FROM embeddings e"
        " JOIN centroids c ON c.label = e.label"
        " QUALIFY row_number() OVER (PARTITION BY e.label ORDER BY round(score, 6) DESC, vec_id) <= 5",
        "centroids",
    ),
)
def _(spark, sf):
    df = read_spread(spark, f"{sf}/embeddings.parquet")
    centres = {row.label: row.centre for row in embeddings.label_centroids(df).collect()}
    return embeddings.search_documents_by_topic(df, centres, 5, label="label", digits=6)
