"""Both ways of every lookup give the same rows, and plans have the intended shape."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from registry.base import songs
from tests.conftest import rows
from tests.oracle import connect, difference
from versemill import joins
from versemill.joins import fits_in_memory, join_lookup
from versemill.operators import lexicons, phrases, sampling, vocabulary
from versemill.operators.columns import add_decade
from versemill.plans import etl

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_keys_are_salted_without_changing_rows(spark, how):
    # a third of all rows has one key, some keys have no match, some are null
    data = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k")
    )
    lookup = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(40)], "k string, v int")
    small = join_lookup(data, lookup, ["k"], ["id"], how)
    large = join_lookup(data, lookup, ["k"], ["id"], how, max_rows=0)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    assert small.columns == large.columns


def test_salting_spreads_the_hot_key(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASK_ROWS", 100)
    data = spark.range(4000).select("id", F.lit("hot").alias("k"))
    lookup = spark.createDataFrame([("hot", 1)], "k string, v int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = join_lookup(data, lookup, ["k"], ["id"], max_rows=0)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) == 4 and max(sizes) < 2000


def test_null_keys_of_a_left_join_are_spread(spark):
    data = spark.range(4000).select("id", F.lit(None).cast("string").alias("k"))
    lookup = spark.createDataFrame([("hot", 1)], "k string, v int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = join_lookup(data, lookup, ["k"], ["id"], "left", max_rows=0)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) == 4 and max(sizes) < 2000 and sum(sizes) == 4000


def test_fits_in_memory(spark):
    df = spark.createDataFrame([("x" * 100,)] * 10, "w string")
    assert fits_in_memory(df)
    assert not fits_in_memory(df, max_rows=9)
    assert not fits_in_memory(df, max_bytes=999)


def test_arrays_are_measured_by_their_size(spark):
    numbers = spark.range(10).select(F.array_repeat(F.lit(1.0), 1000).alias("a"))
    words = spark.range(10).select(F.array_repeat(F.lit("word"), 1000).alias("a"))
    for df in (numbers, words):
        assert fits_in_memory(df) and not fits_in_memory(df, max_bytes=50_000)


ODD = [(1, ["a", "b", None, "a"]), (1, ["c", "b"]), (None, ["a", "b"]), (None, None), (2, [None]), (2, []), (1, ["a", "b", None, "a"])]


def test_lookup_paths_agree_on_repeated_ids_and_nulls(spark):
    df = spark.createDataFrame(ODD, "id int, tokens array<string>")
    lemmas = spark.createDataFrame([("a", "A")], "word string, lemma string")
    tags = spark.createDataFrame([("b", "VB")], "word string, tag string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), (None, "a")], "w1 string, w2 string")
    for apply, table, first in (
        (lexicons.lemmatize, lemmas, ["A", "b", None, "A"]),
        (lexicons.keep_nouns, tags, ["a", None, "a"]),
        (phrases.apply_phrases, pairs, ["a_b", None, "a"]),
    ):
        small = sorted(str(tuple(r)) for r in apply(df, table).collect())
        assert small == sorted(str(tuple(r)) for r in apply(df, table, max_rows=0).collect())
        assert small.count(str((1, first))) == 2


def tokens_frame(spark, lists):
    return spark.createDataFrame(list(enumerate(lists)), "id int, tokens array<string>")


LISTS = [["a", "b", "a", "b", "c"], [], None, ["b", "b", "b"], ["x"], ["a", "b", "c", "d"], ["c", "a"]]


@pytest.mark.parametrize(
    "name",
    ["keep_prolific_artists", "sample_balanced", "group_count_per_row", "bigram_pmi", "filter_trigrams", "bag_of_words"],
)
def test_operators_without_any_broadcast_lookup(spark, monkeypatch, name):
    # every lookup is too large, and many keys count as hot
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "TASK_ROWS", 5)
    assert difference(queries()[name](spark, LARGER), connect(LARGER), oracle_sql()[name]) is None


def test_first_entry_of_a_word_counts(spark):
    df = tokens_frame(spark, [["a", "b"]])
    lemmas = spark.createDataFrame([("a", "y"), ("a", "x")], "word string, lemma string")
    for limit in (10, 0):
        assert lexicons.lemmatize(df, lemmas, max_rows=limit).first().tokens == ["x", "b"]


def test_lexicon_paths_agree(spark):
    df = tokens_frame(spark, LISTS)
    lemmas = spark.createDataFrame([("a", "A"), ("c", None), ("d", "d"), ("b", "B")], "word string, lemma string")
    tags = spark.createDataFrame([("a", "NN"), ("b", "VB"), ("x", "JJ")], "word string, tag string")
    small, large = lexicons.lemmatize(df, lemmas), lexicons.lemmatize(df, lemmas, max_rows=0)
    assert {r.id: r.tokens for r in small.collect()} == {r.id: r.tokens for r in large.collect()}
    assert {r.id: r.tokens for r in small.collect()}[0] == ["A", "B", "A", "B", "c"]
    small, large = lexicons.keep_nouns(df, tags), lexicons.keep_nouns(df, tags, max_rows=0)
    got = {r.id: r.tokens for r in small.collect()}
    assert got == {r.id: r.tokens for r in large.collect()}
    assert got == {0: ["a", "a", "c"], 1: [], 2: None, 3: [], 4: [], 5: ["a", "c", "d"], 6: ["c", "a"]}


def greedy(tokens, pairs):
    if tokens is None:
        return None
    out, i = [], 0
    while i < len(tokens):
        if i + 1 < len(tokens) and (tokens[i], tokens[i + 1]) in pairs:
            out.append(tokens[i] + "_" + tokens[i + 1])
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


def test_apply_phrases_by_hand(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "b")], "w1 string, w2 string")
    got = {r.id: r.tokens for r in phrases.apply_phrases(tokens_frame(spark, LISTS), pairs).collect()}
    assert got == {
        0: ["a_b", "a_b", "c"], 1: [], 2: None, 3: ["b_b", "b"], 4: ["x"], 5: ["a_b", "c", "d"], 6: ["c", "a"],
    }


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.one_of(st.none(), st.lists(st.sampled_from("abc"), max_size=8)), min_size=20, max_size=20),
    st.sets(st.tuples(st.sampled_from("abc"), st.sampled_from("abc")), min_size=1, max_size=5),
)
def test_apply_phrases_is_greedy_on_both_paths(spark, lists, pairs):
    df = tokens_frame(spark, lists)
    known = spark.createDataFrame(sorted(pairs), "w1 string, w2 string")
    expected = {i: greedy(t, pairs) for i, t in enumerate(lists)}
    assert {r.id: r.tokens for r in phrases.apply_phrases(df, known).collect()} == expected
    assert {r.id: r.tokens for r in phrases.apply_phrases(df, known, max_rows=0).collect()} == expected


def test_balanced_sample_is_exact(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 < 7, 1990).when(F.col("id") % 10 < 9, 2000).otherwise(2010).alias("decade"))
    sample = sampling.sample_balanced(df, 0.3)
    assert rows(sample.groupBy("decade").count()) == [(1990, 150), (2000, 150), (2010, 150)]
    ranked = df.orderBy(sampling.sample_hash(seed=20)).where("decade = 1990").limit(150)
    assert rows(sample.where("decade = 1990"), "id") == rows(ranked, "id")
    assert sampling.sample_balanced(df.limit(3), 0.1).count() == 0


def test_hash_sample_ignores_partitioning(spark):
    df = spark.range(10_000)
    sample = sampling.sample_fraction_hash(df, 0.05)
    assert rows(sample) == rows(sampling.sample_fraction_hash(df.repartition(9), 0.05))
    assert 400 < sample.count() < 600
    assert 300 < sampling.sample_fraction(df).count() < 700
    assert sampling.sample_fraction_hash(df, 1.0).count() == 10_000


def test_weights(spark):
    df = spark.createDataFrame([(i, 1990 if i < 6 else 2000) for i in range(8)], "id long, decade int")
    got = dict(rows(sampling.group_frequency_weights(df), "decade", "freq"))
    assert got == pytest.approx({1990: 0.3 * 8 / (2 * 6), 2000: 0.3 * 8 / (2 * 2)})


def test_vocabulary_cut_resolves_ties_by_term(spark):
    df = tokens_frame(spark, [["a", "b", "c", "d"], ["a", "b", "c"], ["a", "e", "e"]])
    terms = vocabulary.build_vocabulary(df)
    assert rows(terms) == [(0, "a", 3, 3), (1, "b", 2, 2), (2, "c", 2, 2), (3, "d", 1, 1), (4, "e", 1, 2)]
    kept = vocabulary.filter_vocabulary(terms, 3, no_below=1, no_above=1.0, keep_n=4)
    assert rows(kept, "term_id", "term") == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert rows(vocabulary.filter_vocabulary(terms, 3, no_below=2, no_above=0.8), "term") == [("b",), ("c",)]
    with pytest.raises(ValueError):
        vocabulary.vocabulary_terms(terms, max_terms=4)
    with pytest.raises(ValueError):
        vocabulary.term_document_matrix_decade(df, [1990], 1980)


# --- plans -----------------------------------------------------------------------------


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    songs(spark, SF).write.parquet(str(tmp_path / "songs"))
    shown = plan(etl.prefilter(spark.read.parquet(str(tmp_path / "songs"))).select("id", "year"))
    assert "GreaterThan(year,1960)" in shown and "LessThanOrEqual(year,2024)" in shown
    assert "ReadSchema: struct<id:bigint,year:bigint,tag:string,lyrics:string>" in shown


def test_song_job_stays_in_the_jvm_and_broadcasts_the_small_side(spark):
    shown = plan(etl.songs_etl(songs(spark, SF), min_songs=3))
    assert "Python" not in shown and "BroadcastHashJoin" in shown
    assert "SortMergeJoin" not in shown and "Cartesian" not in shown


def test_hash_sample_and_balanced_sample_do_not_move_rows(spark):
    df = add_decade(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id AS id", "doc_id AS year", "text"))
    assert "Exchange hashpartitioning" not in plan(sampling.sample_fraction_hash(df))
    final = sampling.sample_balanced(df)
    assert "text" in final.columns
    assert "SortMergeJoin" not in plan(final)


def test_tokens_are_computed_once_before_exploding(spark):
    df = songs(spark, SF).select("id", F.split("lyrics", " ").alias("tokens"))
    shown = plan(vocabulary.term_frequencies(df))
    assert shown.count("split(") == 1


def test_top_terms_limit_before_the_shuffle(spark):
    df = tokens_frame(spark, LISTS).withColumn("decade", (1990 + F.col("id") % 2 * 10).cast("int"))
    assert "WindowGroupLimit" in plan(vocabulary.top_terms_by_decade(df, 3))
