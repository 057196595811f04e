"""Tokens, lexicons, collocations, phrases, vocabulary and term statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import (
    SQL_JOINED,
    cleaned,
    content_words,
    cte,
    joined,
    query,
    songs,
    sql_lemma,
    sql_list,
    sql_long_tokens,
    sql_stop,
    sql_tag,
    sql_words,
    sql_ws,
    staged_tokens,
    tokenized,
    with_ctes,
)
from versemill.functions import text, words
from versemill.functions.token_batches import strip_accents
from versemill.operators import lexicons, ngrams, phrases, vocabulary
from versemill.plans import corpus as corpus_plan
from versemill.staging import stage

DECADES = [1960, 1970, 1980, 1990, 2000, 2010, 2020]


def token_sql(tokens: str, source: str = "cleaned") -> str:
    return with_ctes(f"SELECT {SQL_JOINED} FROM (SELECT id, {tokens} AS tokens FROM {source})", source)


def raw_lyrics(spark, sf):
    return songs(spark, sf).where("lyrics IS NOT NULL")


cte("raw_lyrics", "SELECT id, lyrics FROM songs WHERE lyrics IS NOT NULL", "songs")


# --- tokens ----------------------------------------------------------------------------


@query("tokenize_whitespace", token_sql(sql_ws("lyrics")))
def _(spark, sf):
    return joined(tokenized(spark, sf))


@query("tokenize_words", token_sql(sql_words("lyrics"), "raw_lyrics"))
def _(spark, sf):
    return joined(raw_lyrics(spark, sf).withColumn("tokens", text.tokenize_words(F.col("lyrics"))))


def sql_simple(x: str) -> str:
    return (
        rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{Nl}}\p{{No}}_]+'),"
        " lambda t: length(t) BETWEEN 2 AND 15 AND NOT starts_with(t, '_'))"
    )


@query(
    "tokenize_simple",
    with_ctes(
        "SELECT accents, " + SQL_JOINED + " FROM (SELECT 'kept' AS accents, id, " + sql_simple("lyrics") + " AS tokens"
        " FROM raw_lyrics UNION ALL SELECT 'removed', id, " + sql_simple("strip_accents(lyrics)") + " FROM raw_lyrics)",
        "raw_lyrics",
    ),
)
def _(spark, sf):
    df = raw_lyrics(spark, sf)
    kept = joined(df.withColumn("tokens", text.tokenize_simple(F.col("lyrics"))))
    removed = joined(df.withColumn("tokens", text.tokenize_simple(strip_accents(F.lower("lyrics")))))
    return kept.select(F.lit("kept").alias("accents"), "*").unionByName(
        removed.select(F.lit("removed").alias("accents"), "*")
    )


_SPLIT = " ".join(f"WHEN '{a}{b}' THEN ['{a}', '{b}']" for a, b in text.TREEBANK_CONTRACTIONS)


def sql_treebank(x: str) -> str:
    return f"flatten(list_transform({sql_ws(f'lower({x})')}, lambda t: CASE t {_SPLIT} ELSE [t] END))"


cte(
    "symbol_free",
    "SELECT id, tag, decade, regexp_replace(array_to_string(list_filter("
    f"regexp_extract_all(lyrics, '[{text.WORD}]+|[^{text.WORD}]+'),"
    f" lambda r: NOT regexp_matches(r, '^[{text.WORD}]$')), ''), '[^{text.WORD}{text.SPACE}]', '', 'g') AS lyrics FROM cleaned",
    "cleaned",
)


@query("tokenize_treebank", token_sql(sql_treebank("lyrics"), "symbol_free"))
def _(spark, sf):
    tokens = text.tokenize_treebank(text.strip_singles_and_symbols(F.col("lyrics")))
    return joined(cleaned(spark, sf).withColumn("tokens", tokens))


_TAILS = "|".join(c.replace("'", "[''’]") for c in text.CLITICS)
# a clitic ends where no word character follows; that character is put back


def sql_alpha(x: str) -> str:
    cut = rf"regexp_replace({x}, '(?i)({_TAILS})($|[^{text.WORD}])', ' \2', 'g')"
    return (
        f"list_filter(string_split_regex({cut}, '[{text.SPACE}{text.SEPARATOR}]+'),"
        r" lambda t: regexp_matches(t, '^\p{L}+$'))"
    )


@query("tokenize_alpha", token_sql(sql_alpha("lyrics")))
def _(spark, sf):
    return joined(cleaned(spark, sf).withColumn("tokens", text.tokenize_alpha(F.col("lyrics"))))


@query("filter_token_length", token_sql(sql_long_tokens("tokens"), "tokenized"))
def _(spark, sf):
    return joined(tokenized(spark, sf).withColumn("tokens", text.filter_token_length(F.col("tokens"))))


_LISTS = {
    "default": words.default_words(),
    "noun": words.noun_words(),
    "phrase": words.phrase_words(),
    "v2": words.v2_words(),
    "ngram": words.ngram_words(),
}


@query(
    "remove_stop_words",
    with_ctes(
        f"SELECT list, {SQL_JOINED} FROM ("
        + " UNION ALL ".join(
            f"SELECT '{name}' AS list, id, {sql_stop('tokens', listed)} AS tokens FROM tokenized"
            for name, listed in _LISTS.items()
        )
        + ")",
        "tokenized",
    ),
)
def _(spark, sf):
    tokens = tokenized(spark, sf)
    per_list = F.inline(
        F.array(
            *[
                F.struct(F.lit(name).alias("list"), text.remove_stop_words(F.col("tokens"), listed).alias("kept"))
                for name, listed in _LISTS.items()
            ]
        )
    )
    rows = tokens.select("id", per_list)
    return rows.select(
        "list", "id", F.array_join("kept", " ").alias("tokens"), F.size("kept").cast("long").alias("n_tokens")
    )


def lemma_lexicon(df):
    return lexicons.suffix_lemmas(lexicons.vocabulary_words(df))


def tag_lexicon(df):
    return lexicons.suffix_tags(lexicons.vocabulary_words(df))


def sql_lemmas(x: str) -> str:
    return f"list_transform({x}, lambda t: {sql_lemma('t')})"


def sql_nouns(x: str) -> str:
    return f"list_filter({x}, lambda t: {sql_tag('t')} = 'NN')"


@query("lemmatize", token_sql(sql_lemmas("tokens"), "tokenized"))
def _(spark, sf):
    df = staged_tokens(spark, sf)
    return joined(lexicons.lemmatize(df, lemma_lexicon(df)))


@query("keep_nouns", token_sql(sql_nouns("tokens"), "tokenized"))
def _(spark, sf):
    df = staged_tokens(spark, sf)
    return joined(lexicons.keep_nouns(df, tag_lexicon(df)))


@query("pluggable_preprocess", token_sql(sql_stop(sql_words("lyrics"), words.ENGLISH)))
def _(spark, sf):
    def mine(lyrics):
        return text.remove_stop_words(text.tokenize_words(lyrics), words.ENGLISH)

    return joined(corpus_plan.pluggable_preprocess(cleaned(spark, sf), mine))


@query("preprocess_default", token_sql(sql_lemmas(sql_stop(sql_alpha("lyrics"), words.default_words()))))
def _(spark, sf):
    df = cleaned(spark, sf)
    lexicon = lemma_lexicon(df.select(text.tokenize_alpha(F.col("lyrics")).alias("tokens")))
    return joined(corpus_plan.preprocess_default(df, lexicon))


@query(
    "preprocess_noun",
    token_sql(sql_nouns(sql_stop(sql_long_tokens(sql_ws("lyrics"), numeric=False), words.noun_words()))),
)
def _(spark, sf):
    df = cleaned(spark, sf)
    lexicon = tag_lexicon(df.select(text.tokenize_whitespace(F.col("lyrics")).alias("tokens")))
    return joined(corpus_plan.preprocess_noun(df, lexicon))


@query(
    "preprocess_v2",
    token_sql(sql_stop(sql_lemmas(sql_long_tokens(sql_words("lyrics"))), words.v2_words())),
)
def _(spark, sf):
    df = cleaned(spark, sf)
    lexicon = lemma_lexicon(df.select(text.tokenize_words(F.col("lyrics")).alias("tokens")))
    return joined(corpus_plan.preprocess_v2(df, lexicon))


# --- collocations ----------------------------------------------------------------------

MIN_COUNT = ngrams.MIN_COUNT


def sql_ngrams(name: str, source: str, n: int) -> None:
    """Define ``<name>`` as the positions and parts of n-grams of ``source``."""
    lead = ", ".join(
        f"lead(w1, {i}) OVER (PARTITION BY id ORDER BY pos) AS w{i + 1}" for i in range(1, n)
    )
    cte(
        f"{source}_words",
        f"SELECT id, unnest(tokens) AS w1, generate_subscripts(tokens, 1) AS pos FROM {source}",
        source,
    )
    cte(name, f"SELECT * FROM (SELECT id, pos, w1, {lead} FROM {source}_words) WHERE w{n} IS NOT NULL", f"{source}_words")


sql_ngrams("bigrams", "tokenized", 2)
sql_ngrams("trigrams", "tokenized", 3)
cte("word_n", "SELECT w1 AS word, count(*) AS n FROM tokenized_words GROUP BY 1", "tokenized_words")
cte("total", "SELECT CAST(sum(n) AS DOUBLE) AS total FROM word_n", "word_n")
cte(
    "bigram_scores",
    "SELECT w1, w2, b.n, log2(b.n * total / (CAST(a1.n AS DOUBLE) * a2.n)) AS pmi"
    f" FROM (SELECT w1, w2, count(*) AS n FROM bigrams GROUP BY ALL HAVING count(*) >= {MIN_COUNT}) b"
    " JOIN word_n a1 ON a1.word = w1 JOIN word_n a2 ON a2.word = w2, total",
    "bigrams",
    "word_n",
    "total",
)
cte(
    "trigram_scores",
    "SELECT w1, w2, w3, b.n, log2(b.n * total * total / (CAST(a1.n AS DOUBLE) * a2.n * a3.n)) AS pmi"
    f" FROM (SELECT w1, w2, w3, count(*) AS n FROM trigrams GROUP BY ALL HAVING count(*) >= {MIN_COUNT}) b"
    " JOIN word_n a1 ON a1.word = w1 JOIN word_n a2 ON a2.word = w2 JOIN word_n a3 ON a3.word = w3, total",
    "trigrams",
    "word_n",
    "total",
)


def _rounded(df, column="pmi"):
    return df.withColumn(column, F.round(column, 6))


@query("bigram_pmi", with_ctes("SELECT w1, w2, n, round(pmi, 6) AS pmi FROM bigram_scores", "bigram_scores"))
def _(spark, sf):
    return _rounded(ngrams.bigram_pmi(tokenized(spark, sf)))


@query("trigram_pmi", with_ctes("SELECT w1, w2, w3, n, round(pmi, 6) AS pmi FROM trigram_scores", "trigram_scores"))
def _(spark, sf):
    return _rounded(ngrams.trigram_pmi(tokenized(spark, sf)))


_BARRED = sql_list((*words.ENGLISH, *ngrams.REMNANTS))
cte(
    "chosen_bigrams",
    "SELECT * FROM (SELECT w1 || ' ' || w2 AS phrase, w1, w2, n, round(pmi, 6) AS pmi FROM bigram_scores"
    f" WHERE pmi > 5 AND w1 NOT IN {_BARRED} AND w2 NOT IN {_BARRED}"
    f" AND ({sql_tag('w1')} IN ('JJ', 'NN') OR {sql_tag('w2')} = 'NN')"
    " ORDER BY round(pmi, 6) DESC, w1, w2 LIMIT 500) WHERE length(w1) > 2 OR length(w2) > 2",
    "bigram_scores",
)
cte(
    "chosen_trigrams",
    "SELECT * FROM (SELECT w1 || ' ' || w2 || ' ' || w3 AS phrase, w1, w2, w3, n, round(pmi, 6) AS pmi FROM trigram_scores"
    f" WHERE pmi > 5 AND w1 NOT IN {_BARRED} AND w2 NOT IN {_BARRED} AND w3 NOT IN {_BARRED}"
    f" AND ({sql_tag('w1')} IN ('JJ', 'NN') OR {sql_tag('w2')} IN ('JJ', 'NN'))"
    " ORDER BY round(pmi, 6) DESC, w1, w2, w3 LIMIT 500) WHERE length(w1) > 2 OR (length(w2) > 2 AND length(w3) > 2)",
    "trigram_scores",
)


def chosen_bigrams(df):
    return ngrams.filter_bigrams(_rounded(ngrams.bigram_pmi(df)), tag_lexicon(df), words.ENGLISH)


def chosen_trigrams(df):
    return ngrams.filter_trigrams(_rounded(ngrams.trigram_pmi(df)), tag_lexicon(df), words.ENGLISH)


@query("filter_bigrams", with_ctes("SELECT * FROM chosen_bigrams", "chosen_bigrams"))
def _(spark, sf):
    return chosen_bigrams(staged_tokens(spark, sf))


@query("filter_trigrams", with_ctes("SELECT * FROM chosen_trigrams", "chosen_trigrams"))
def _(spark, sf):
    return chosen_trigrams(staged_tokens(spark, sf))


@query(
    "join_ngrams_in_text",
    with_ctes(
        "SELECT id, list_reduce(list_prepend(lyrics, (SELECT list(phrase ORDER BY part, pmi DESC, phrase) FROM"
        " (SELECT 1 AS part, phrase, pmi FROM chosen_trigrams UNION ALL SELECT 2, phrase, pmi FROM chosen_bigrams))),"
        " lambda acc, g: replace(acc, g, replace(g, ' ', '_'))) AS lyrics FROM cleaned",
        "chosen_trigrams",
        "chosen_bigrams",
        "cleaned",
    ),
)
def _(spark, sf):
    df = staged_tokens(spark, sf)
    lexicon = stage(tag_lexicon(df), "tag-lexicon")
    bigrams, trigrams = (_rounded(scores) for scores in ngrams.collocations(df))
    chosen = ngrams.ranked_phrases(
        ngrams.filter_trigrams(trigrams, lexicon, words.ENGLISH), ngrams.filter_bigrams(bigrams, lexicon, words.ENGLISH)
    )
    return cleaned(spark, sf).select("id", ngrams.join_ngrams_in_text(F.col("lyrics"), chosen).alias("lyrics"))


# --- phrases ---------------------------------------------------------------------------


def sql_phrases(name: str, grams: str, counts: str, min_count: int, threshold: int) -> None:
    cte(
        name,
        f"SELECT w1, w2, b.n, (b.n - {min_count}) / CAST(a1.n AS DOUBLE) / CAST(a2.n AS DOUBLE) * v AS score FROM"
        f" (SELECT w1, w2, count(*) AS n FROM {grams} GROUP BY ALL) b JOIN {counts} a1 ON a1.word = w1"
        f" JOIN {counts} a2 ON a2.word = w2, (SELECT (SELECT count(*) FROM {counts})"
        f" + (SELECT count(*) FROM (SELECT DISTINCT w1, w2 FROM {grams})) AS v)"
        f" WHERE (b.n - {min_count}) / CAST(a1.n AS DOUBLE) / CAST(a2.n AS DOUBLE) * v > {threshold}",
        grams,
        counts,
    )


def sql_merged(name: str, grams_words: str, learned: str, source: str) -> None:
    """Define ``<name>`` as ``source`` with learned pairs merged."""
    cte(
        f"{name}_marked",
        f"SELECT t.id, t.pos, t.w1, t.w2, p.w1 IS NOT NULL AS listed FROM"
        f" (SELECT *, lead(w1) OVER (PARTITION BY id ORDER BY pos) AS w2 FROM {grams_words}) t"
        f" LEFT JOIN (SELECT DISTINCT w1, w2 FROM {learned}) p ON p.w1 = t.w1 AND p.w2 = t.w2",
        grams_words,
        learned,
    )
    cte(
        f"{name}_runs",
        "SELECT *, listed AND (row_number() OVER (PARTITION BY id, run, listed ORDER BY pos)) % 2 = 1 AS taken FROM"
        " (SELECT *, sum(CASE WHEN listed THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY pos) AS run"
        f" FROM {name}_marked)",
        f"{name}_marked",
    )
    cte(
        name,
        "SELECT id, coalesce(tokens, []) AS tokens FROM (SELECT id FROM " + source + ") LEFT JOIN"
        " (SELECT id, list(CASE WHEN taken THEN w1 || '_' || w2 ELSE w1 END ORDER BY pos) AS tokens FROM"
        " (SELECT *, coalesce(lag(taken) OVER (PARTITION BY id ORDER BY pos), false) AS absorbed"
        f" FROM {name}_runs) WHERE NOT absorbed GROUP BY id) USING (id)",
        f"{name}_runs",
        source,
    )


PHRASE_MIN, PHRASE_THRESHOLD = 5, 100
sql_phrases("learned", "bigrams", "word_n", PHRASE_MIN, PHRASE_THRESHOLD)
sql_merged("merged", "tokenized_words", "learned", "tokenized")


@query(
    "learn_phrases",
    with_ctes("SELECT w1, w2, n, round(score, 4) AS score FROM learned", "learned"),
)
def _(spark, sf):
    return phrases.learn_phrases(tokenized(spark, sf), PHRASE_MIN, PHRASE_THRESHOLD).withColumn(
        "score", F.round("score", 4)
    )


@query("apply_phrases", with_ctes(f"SELECT {SQL_JOINED} FROM merged", "merged"))
def _(spark, sf):
    df = staged_tokens(spark, sf)
    return joined(phrases.apply_phrases(df, phrases.learn_phrases(df, PHRASE_MIN, PHRASE_THRESHOLD)))


# the n-gram pipeline: pairs, then pairs of merged tokens, then lemmas
cte("ngram_source", f"SELECT id, {sql_stop(sql_simple('lyrics'), words.ngram_words())} AS tokens FROM cleaned", "cleaned")
sql_ngrams("source_bigrams", "ngram_source", 2)
cte("source_n", "SELECT w1 AS word, count(*) AS n FROM ngram_source_words GROUP BY 1", "ngram_source_words")
sql_phrases("first_phrases", "source_bigrams", "source_n", PHRASE_MIN, PHRASE_THRESHOLD)
sql_merged("once_merged", "ngram_source_words", "first_phrases", "ngram_source")
sql_ngrams("once_bigrams", "once_merged", 2)
cte("once_n", "SELECT w1 AS word, count(*) AS n FROM once_merged_words GROUP BY 1", "once_merged_words")
sql_phrases("second_phrases", "once_bigrams", "once_n", PHRASE_MIN, PHRASE_THRESHOLD)
sql_merged("twice_merged", "once_merged_words", "second_phrases", "once_merged")


@query(
    "preprocess_ngram",
    with_ctes(
        f"SELECT {SQL_JOINED} FROM (SELECT id, "
        + sql_lemmas(r"list_filter(tokens, lambda t: regexp_matches(t, '^\p{L}+$'))")
        + " AS tokens FROM twice_merged)",
        "twice_merged",
    ),
)
def _(spark, sf):
    tokens = stage(corpus_plan.ngram_tokens(cleaned(spark, sf)).select("id", "tokens"), "ngram-tokens")
    pairs = stage(phrases.learn_phrases(tokens, PHRASE_MIN, PHRASE_THRESHOLD, staged=True), "pairs")
    triples = phrases.learn_phrases(phrases.apply_phrases(tokens, pairs), PHRASE_MIN, PHRASE_THRESHOLD)
    return joined(corpus_plan.preprocess_ngram(tokens, pairs, triples, lemma_lexicon(tokens), column=None))


# --- vocabulary and term statistics ----------------------------------------------------

cte("tokenized_terms", "SELECT id, decade, unnest(tokens) AS term FROM tokenized", "tokenized")
cte(
    "vocabulary",
    "SELECT row_number() OVER (ORDER BY term) - 1 AS term_id, term, count(DISTINCT id) AS doc_freq, count(*) AS term_freq"
    " FROM tokenized_terms GROUP BY term",
    "tokenized_terms",
)


@query("build_vocabulary", with_ctes("SELECT * FROM vocabulary", "vocabulary"))
def _(spark, sf):
    return vocabulary.build_vocabulary(tokenized(spark, sf))


_KEEP = 300
cte(
    "kept_vocabulary",
    "SELECT row_number() OVER (ORDER BY term) - 1 AS term_id, term, doc_freq, term_freq FROM (SELECT * FROM vocabulary"
    f" WHERE doc_freq >= 20 AND doc_freq <= 0.8 * (SELECT count(*) FROM tokenized) ORDER BY doc_freq DESC, term LIMIT {_KEEP})",
    "vocabulary",
    "tokenized",
)


@query("filter_vocabulary", with_ctes("SELECT * FROM kept_vocabulary", "kept_vocabulary"))
def _(spark, sf):
    df = staged_tokens(spark, sf)
    return vocabulary.filter_vocabulary(vocabulary.build_vocabulary(df), df.count(), no_below=20, keep_n=_KEEP)


cte(
    "model_vocabulary",
    "SELECT row_number() OVER (ORDER BY term) - 1 AS term_id, term, doc_freq, term_freq FROM vocabulary"
    " WHERE doc_freq >= 20 AND doc_freq <= 0.8 * (SELECT count(*) FROM tokenized)",
    "vocabulary",
    "tokenized",
)


@query(
    "bag_of_words",
    with_ctes(
        "SELECT id, term_id, term, count(*) AS tf FROM tokenized_terms JOIN model_vocabulary USING (term) GROUP BY ALL",
        "tokenized_terms",
        "model_vocabulary",
    ),
)
def _(spark, sf):
    df = staged_tokens(spark, sf)
    kept = vocabulary.filter_vocabulary(vocabulary.build_vocabulary(df), df.count(), no_below=20, keep_n=None)
    return vocabulary.bag_of_words(df, kept)


_DECADE_LIST = ", ".join(str(d) for d in DECADES)


@query(
    "term_document_matrix",
    with_ctes(
        f"SELECT id, decade, term, count(*) AS n FROM tokenized_terms WHERE decade IN ({_DECADE_LIST}) GROUP BY ALL",
        "tokenized_terms",
    ),
)
def _(spark, sf):
    return vocabulary.term_document_matrix(tokenized(spark, sf), DECADES)


@query(
    "term_document_matrix_decade",
    with_ctes("SELECT id, decade, term, count(*) AS n FROM tokenized_terms WHERE decade = 1990 GROUP BY ALL", "tokenized_terms"),
)
def _(spark, sf):
    return vocabulary.term_document_matrix_decade(tokenized(spark, sf), DECADES, 1990)


@query(
    "top_terms_by_decade",
    with_ctes(
        "SELECT decade, CAST(row_number() OVER (PARTITION BY decade ORDER BY count(*) DESC, term) AS INTEGER) AS rank,"
        " term, count(*) AS n FROM (SELECT decade, unnest(tokens) AS term FROM content) GROUP BY decade, term"
        " QUALIFY rank <= 15",
        "content",
    ),
)
def _(spark, sf):
    return vocabulary.top_terms_by_decade(content_words(spark, sf), 15)
