from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tests.conftest import rows
from versemill.functions import gram_counts as kernel
from versemill.operators import ngrams, phrases, vocabulary
from versemill.plans import corpus
from versemill.staging import stage

LISTS = [["a", "b", "a", "b", "a"], [], None, ["b"], ["a", None, "b", "a"], ["é", "a", "b", "", "a"], ["a", "b", "a"]]


def brute(lists, n):
    found = Counter()
    for tokens in lists:
        for k in range(len(tokens or []) - n + 1):
            if None not in tokens[k : k + n]:
                found[tuple(tokens[k : k + n])] += 1
    return found


@pytest.mark.parametrize("n", [1, 2, 3])
def test_batch_counts(n):
    for lists in (LISTS, LISTS[1:3], [], [["x"]]):
        got = kernel.count_grams_batch(pa.array(lists, pa.list_(pa.string())), n).to_pydict()
        columns = [got[f"w{k}"] for k in range(1, n + 1)]
        assert dict(zip(zip(*columns), got["n"])) == dict(brute(lists, n))


def test_sliced_batches_count_alike():
    whole = pa.array(LISTS, pa.list_(pa.string()))
    got = kernel.count_grams_batch(whole.slice(3, 3), 2).to_pydict()
    assert dict(zip(zip(got["w1"], got["w2"]), got["n"])) == dict(brute(LISTS[3:6], 2))
    assert kernel.row_counts_batch(whole.slice(4, 2)).to_pylist() == kernel.row_counts_batch(whole).to_pylist()[4:6]


def test_row_counts():
    got = kernel.row_counts_batch(pa.array(LISTS, pa.list_(pa.string()))).to_pylist()
    for tokens, found in zip(LISTS, got):
        want = None if tokens is None else Counter(t for t in tokens if t is not None)
        assert (found if found is None else {s["term"]: s["n"] for s in found}) == want


@pytest.mark.parametrize("bits", [kernel.FILTER_BITS, 1 << 16])
def test_filtered_counts_equal_plain_counts(spark, bits, monkeypatch):
    monkeypatch.setattr(kernel.gram_filter, "__defaults__", (bits,))
    random.seed(1)
    lists = [[f"w{int(random.paretovariate(0.6))}" for _ in range(random.randint(0, 60))] for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in lists], "tokens array<string>").repartition(3)
    tables = ngrams.gram_counts(df, 3, 5)
    assert rows(tables[0], "w1", "n") == sorted((*g, n) for g, n in brute(lists, 1).items())
    for n in (2, 3):
        want = sorted((*g, c) for g, c in brute(lists, n).items() if c >= 5)
        assert want and rows(tables[n - 1], *(f"w{k}" for k in range(1, n + 1)), "n") == want


def test_filter_keeps_rare_ngrams_from_the_shuffle(spark):
    frequent = kernel.gram_filter(spark.createDataFrame([("a",), ("b",)], "w1 string"), ["w1"])
    assert int(np.unpackbits(frequent).sum()) == 2
    lists = pa.array([["a", "b", "x", "a", "y", "b", "a"]], pa.list_(pa.string()))
    got = kernel.count_grams_batch(lists, 2, frequent).to_pydict()
    assert sorted(zip(got["w1"], got["w2"])) == [("a", "b"), ("b", "a")]


def one_after_the_other(text, phrases):
    for phrase in phrases:
        text = text.replace(phrase, phrase.replace(" ", "_"))
    return text


def test_joined_phrases_equal_replacement_in_order(spark):
    random.seed(2)
    words = ["a", "b", "ab", "b_a", "c", "é"]
    phrases = [" ".join(random.choices(words, k=random.randint(2, 3))) for _ in range(40)]
    # a phrase that only comes about by an earlier join, a repeated one, and one of no use
    phrases = ["a b", "a_b c", "b c", *phrases, "a b", "zz zz"]
    texts = [" ".join(random.choices(words, k=random.randint(0, 25))) for _ in range(200)] + [None, "", "a b c", "xa by"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, x string").repartition(2)
    got = dict(rows(df.withColumn("x", ngrams.join_ngrams_in_text(F.col("x"), phrases)).where("x IS NOT NULL"), "id", "x"))
    assert got == {k: one_after_the_other(t, phrases) for k, t in enumerate(texts) if t is not None}
    assert got[202] == "a_b_c"


def test_absent_phrases_are_never_looked_at():
    class Watched(list):
        def __getitem__(self, place):
            seen.add(place)
            return super().__getitem__(place)

    seen = set()
    phrases = Watched(f"w{k} w{k + 1}" for k in range(1000))
    find = kernel.found_phrases(list(phrases))
    out = ngrams.join_ngrams_batch(pa.array(["w5 w6 w7 w9", "nothing", None]), phrases, find)
    assert out.to_pylist() == ["w5_w6_w7 w9", "nothing", None] and seen == {5, 6}


def test_term_frequencies(spark):
    df = spark.createDataFrame([(t,) for t in LISTS * 3], "tokens array<string>").repartition(4)
    total, held = Counter(), Counter()
    for tokens in LISTS * 3:
        total.update(t for t in tokens or [] if t is not None)
        held.update({t for t in tokens or [] if t is not None})
    want = sorted((t, held[t], total[t]) for t in total)
    assert rows(vocabulary.term_frequencies(df), "term", "doc_freq", "term_freq") == want
    assert vocabulary.term_frequencies(df.where("false")).count() == 0


def test_counts_need_no_exchange_by_document(spark):
    df = spark.createDataFrame([(1, 1990, ["a", "b", "a"]), (2, 2000, []), (3, 1990, None)], "id long, decade int, tokens array<string>")
    terms = spark.createDataFrame([(0, "a"), (1, "b")], "term_id long, term string")
    for made in (vocabulary.bag_of_words(df, terms), vocabulary.term_document_matrix(df, [1990, 2000])):
        assert "Exchange hash" not in made._jdf.queryExecution().executedPlan().toString()
    assert rows(vocabulary.bag_of_words(df, terms)) == [(1, 0, "a", 2), (1, 1, "b", 1)]
    assert rows(vocabulary.term_document_matrix(df, [1990])) == [(1, 1990, "a", 2), (1, 1990, "b", 1)]


def test_counting_steps_are_bounded_whatever_the_batch(monkeypatch):
    monkeypatch.setattr(kernel, "STEP_TOKENS", 6)
    lists = pa.array(LISTS * 20 + [["x"] * 9], pa.list_(pa.string()))
    steps = list(kernel.in_steps(lists))
    assert pa.concat_arrays(steps).equals(lists)
    assert all(sum(map(len, filter(None, s.to_pylist()))) <= 6 or len(s) == 1 for s in steps)
    counted = kernel.by_steps(lists, kernel.row_counts_batch).to_pylist()
    as_sets = [None if c is None else sorted((e["term"], e["n"]) for e in c) for c in counted]
    assert as_sets == [None if t is None else sorted(Counter(x for x in t if x is not None).items()) for t in lists.to_pylist()]
    texts = pa.array(["abc", None, "", "abcdefgh", "é"])
    assert [s.to_pylist() for s in kernel.in_steps(texts, 4)] == [["abc", None, ""], ["abcdefgh"], ["é"]]


def test_terms_and_pairs_are_counted_across_steps(spark, monkeypatch):
    seen = []
    whole = kernel.count_terms_batch
    lists = pa.array(LISTS * 3, pa.list_(pa.string()))
    parts = [whole(step) for step in kernel.in_steps(lists, 5)]
    assert len(parts) > 3
    for part in parts:
        seen += zip(*part.to_pydict().values())
    found = {t: (sum(d for u, d, _ in seen if u == t), sum(f for u, _, f in seen if u == t)) for t, _, _ in seen}
    want = Counter(t for tokens in lists.to_pylist() for t in tokens or [] if t is not None)
    assert {t: f for t, (_, f) in found.items()} == want
    assert all(d == sum(t in (tokens or []) for tokens in lists.to_pylist()) for t, (d, _) in found.items())


def test_only_tags_of_frequent_pairs_are_looked_up(spark, monkeypatch):
    made = {}
    keep = ngrams.stage
    monkeypatch.setattr(ngrams, "stage", lambda df, label: made.setdefault(label, keep(df, label)))
    grams = spark.createDataFrame([("sun", "light", 60, 6.0), ("run", "ing", 60, 9.0), ("low", "pmi", 60, 1.0)], "w1 string, w2 string, n long, pmi double")
    lexicon = spark.createDataFrame([(w, "NN") for w in ("sun", "light", "low", "pmi")] + [("ing", "VBG"), ("run", "VB")] + [(f"w{i}", "NN") for i in range(50)], "word string, tag string")
    assert rows(ngrams.filter_bigrams(grams, lexicon, ["the"]), "phrase") == [("sun light",)]
    assert {r.word for r in made["tags"].collect()} == {"sun", "light", "run", "ing"}


def test_ngram_query_splits_texts_once(spark):
    shown = queries()["preprocess_ngram"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in shown and "ngram-tokens" in shown


def test_ngram_preprocessing_of_given_tokens(spark):
    texts = ["new york city lights", "new york city", None, "cities of new york", "x", "", "new york city nights"]
    df = spark.createDataFrame([*enumerate(texts), (1, "new york"), (None, "york city")], "id int, lyrics string")
    pairs = spark.createDataFrame([("new", "york")], "w1 string, w2 string")
    triples = spark.createDataFrame([("new_york", "city")], "w1 string, w2 string")
    lemmas = spark.createDataFrame([("cities", "city"), ("lights", "light")], "word string, lemma string")
    whole = corpus.preprocess_ngram(df, pairs, triples, lemmas).select("id", "tokens")
    tokens = corpus.ngram_tokens(df).select("id", "tokens")
    given = corpus.preprocess_ngram(tokens, pairs, triples, lemmas, column=None)
    assert sorted(map(str, given.collect())) == sorted(map(str, whole.collect()))
    assert [r.tokens for r in given.where("id = 0").collect()] == [["light"]]


def test_phrases_of_a_written_table_write_no_lists(spark, monkeypatch):
    lists = [t.split() if t else None for t in ("a b c a b", "a b a b a b", None, "c a b", "b")]
    df = stage(spark.createDataFrame([(k, t) for k, t in enumerate(lists)], "id int, tokens array<string>"), "given")
    want = rows(phrases.learn_phrases(df, 1, 0.1))
    labels = []
    monkeypatch.setattr(ngrams, "stage", lambda df, label: labels.append(label) or stage(df, label))
    assert rows(phrases.learn_phrases(df, 1, 0.1, staged=True)) == want and want
    assert labels and "token-lists" not in labels
