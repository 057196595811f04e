from __future__ import annotations

import zlib

import numpy as np
import pytest

from tests.llm.helpers import SCHEMA, documents, prose
from versemill.llm import language, quality, toxicity


def remainder(i, folds):
    return zlib.crc32(str(i).encode()) % folds


def labelled(spark, column, of):
    given = [(i, int(of(i))) for i in range(600)]
    return spark.createDataFrame([*given, (None, 1), (3, None), (3, 0)], f"doc_id long, {column} int")


def toxic_text(i):
    words = prose(i, 60).split()
    if i % 5 == 2:
        for k in range(3):
            words[10 + 7 * k] = ["fool", "vequabc", "vequxyz"][(i + k) % 3] + ("," if k else "!")
    return " ".join(words)


@pytest.fixture(scope="module")
def toxic(spark):
    docs = documents(spark, [(i, toxic_text(i)) for i in range(600)] + [(700, None), (701, ""), (None, "fool " * 30), (702, "x " * 30_000)])
    model = toxicity.train_toxicity(docs, labelled(spark, "toxic", lambda i: i % 5 == 2))
    return model, toxicity.score_toxicity(docs, model, keep=["doc_id", "text"]).collect()


def test_toxicity_on_the_held_out_fold(toxic):
    _, found = toxic
    held = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 600 and remainder(r["doc_id"], 5) == 0]
    assert len(held) > 80
    assert all((r["toxicity"] >= 0.5) == (r["doc_id"] % 5 == 2) for r in held)


def test_toxicity_of_edge_texts_and_spans(toxic):
    _, found = toxic
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[700]["toxicity"] == by_id[701]["toxicity"] < 0.5
    assert by_id[None]["toxicity"] > 0.5 and by_id[702]["toxicity"] < 0.5
    row = by_id[2]
    words = [row["text"][s["start"] : s["end"]].strip(",!") for s in row["toxic_spans"]]
    assert words and all(w == "fool" or w.startswith("vequ") for w in words)


def test_marginals_equal_enumeration():
    generator = np.random.default_rng(3)
    lengths = np.array([3, 0, 5, 1])
    emission, weights = generator.normal(size=9), generator.normal(size=4)
    chance, expected = toxicity._Chains(lengths).marginals(emission, weights)
    want, counts, at = [], np.zeros(4), 0
    for n in lengths:
        own, total, ones, steps = emission[at : at + n], 0.0, np.zeros(n), np.zeros(4)
        at += n
        for code in range(2**n) if n else ():
            state = np.array([(code >> k) & 1 for k in range(n)])
            kinds = np.array([state[0], *(((1 - state[:-1]) @ state[1:], state[:-1] @ (1 - state[1:]), state[:-1] @ state[1:]))])
            p = np.exp(own @ state + weights @ kinds)
            total, ones, steps = total + p, ones + p * state, steps + p * kinds
        if n:
            want += (ones / total).tolist()
            counts += steps / total
    assert np.allclose(chance, want) and np.allclose(expected, counts)


def test_classifiers_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    docs = documents(spark, [(1, "some text"), (2, None)])
    for column, train, score in (
        ("toxicity", toxicity.train_toxicity, toxicity.score_toxicity),
        ("quality", quality.train_quality, quality.score_quality),
    ):
        model = train(docs, none)
        assert len({r[column] for r in score(docs, model).collect()}) == 1
        assert score(documents(spark, []), model).count() == 0
        assert train(documents(spark, []), none)


def quality_text(i):
    text = prose(i, 40 + i % 30)
    return " ".join(w + "$$$" for w in text.upper().split()) if i % 4 == 1 else text


def test_quality_on_the_held_out_fold(spark):
    docs = documents(spark, [(i, quality_text(i)) for i in range(600)] + [(700, None), (701, ""), (702, "long " * 50_000)])
    model = quality.train_quality(docs, labelled(spark, "quality", lambda i: i % 4 != 1))
    found = {r["doc_id"]: r["quality"] for r in quality.score_quality(docs, model).collect()}
    held = [i for i in range(600) if remainder(i, 5) == 0]
    assert all((found[i] >= 0.3) == (i % 4 != 1) for i in held)
    assert found[700] == found[701] and all(0 <= s <= 1 for s in found.values())


def test_flat_trees_equal_a_walk():
    generator = np.random.default_rng(1)
    rows = generator.normal(size=(400, 5))
    label = (rows[:, 0] * rows[:, 1] > 0).astype(float)
    model = quality.boost(rows, label, np.ones(400), trees=20)
    scores = model.score(rows)
    assert ((scores > 0.5) == label).mean() > 0.95
    binned = model.bins(rows)
    for i in range(0, 400, 37):
        total = model.base
        for t in range(20):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + 1 + (binned[i, model.feature[t, node]] > model.limit[t, node])
            total += model.value[t, node - (2**quality.DEPTH - 1)]
        assert np.isclose(scores[i], 1 / (1 + np.exp(-total)))


def test_language_profiles(spark):
    samples = {"aa": "kala mola tala", "bb": "shrim gruth brosh", "éé": "éclair où été"}
    given, langs = [], {}
    for i in range(90):
        lang = sorted(samples)[i % 3]
        words = samples[lang].split()
        given.append((i, " ".join(words[(i * k) % 3] for k in range(1, 12)) + "."))
        langs[i] = lang
    given += [(100, None), (101, ""), (102, "12 34 !?"), (None, "kala mola"), (103, "shrim " * 40_000)]
    langs |= {100: None, 103: None, None: None}
    docs = documents(spark, given, langs)
    profiles = language.learn_profiles(docs)
    assert profiles.languages == sorted(samples)
    found = {r["doc_id"]: r for r in language.identify_language(docs, profiles).collect()}
    assert all(found[i]["lang_pred"] == langs[i] for i in range(90))
    assert {found[i]["lang_pred"] for i in (100, 101, 102)} == {"und"}
    assert found[None]["lang_pred"] == "aa" and found[103]["lang_pred"] == "bb"
    assert all(0 <= r["lang_score"] <= 1 for r in found.values())
    nothing = language.learn_profiles(spark.createDataFrame([], SCHEMA))
    assert {r["lang_pred"] for r in language.identify_language(docs, nothing).collect()} == {"und"}


def test_grams_equal_brute_force():
    texts = ["Ab c", "", "12", "é-Éx", "ß"]
    for text, got in zip(texts, language.gram_lists(texts)):
        padded = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        want = []
        for word in padded:
            p = f" {word} "
            want += [p[i : i + n] for n in (1, 2, 3) for i in range(len(p) - n + 1) if p[i : i + n] != " "]
        numbers = [sum(ord(c) << (21 * k) for k, c in enumerate(g)) for g in want]
        assert sorted(numbers) == sorted(got.tolist())
