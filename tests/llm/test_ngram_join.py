from __future__ import annotations

import random

import numpy as np
import pytest

from tests.conftest import rows
from tests.llm.helpers import documents, prose
from tests.llm.test_exact_and_near import brute_near
from versemill.llm import ngram_join
from versemill.llm.count_tree import CountTree, least_common


def corpus():
    random.seed(8)
    given, number = [], 0
    for family in range(5):
        base = prose(family, 90 + 70 * family).split()
        for copy in range(14):
            words = list(base)
            for k in range(copy // 2):  # from exact copies to some below the threshold
                words[random.randrange(len(words))] = f"new{family}x{copy}x{k}"
            given.append((1000 - number, " ".join(words)))
            number += 1
    base = prose(70, 200).split()
    for copy in range(60):  # a large group around the threshold
        words = list(base)
        for k in range(2 + copy % 5):
            words[random.randrange(len(words))] = f"edit{copy}x{k}"
        given.append((2000 + copy, " ".join(words)))
    passage = prose(99, 120)
    given += [(3000 + k, prose(200 + k, 3 + k % 9) + " " + passage) for k in range(30)]
    for size in range(1, 26):  # small sets, where one n-gram decides
        text = prose(300 + size, size + 2, 60)
        given += [(4000 + size, text), (4100 + size, text + " more"), (4200 + size, "less " + text.upper())]
    given += [(5000, ""), (5001, None), (5002, " \t "), (5003, "one two"), (5004, "ONE two"), (5005, "One")]
    return given


@pytest.mark.parametrize("words,percent", [(3, 90), (2, 75)])
def test_components_equal_brute_force(spark, words, percent):
    given = corpus()
    got = ngram_join.similar_texts(documents(spark, given), words=words, percent=percent)
    want = [r[:3] for r in brute_near(given, words, percent)]
    assert rows(got, "doc_id", "n_shingles", "component_id") == want


def test_components_with_small_tiles_and_hubs(spark, monkeypatch):
    given = corpus()
    want = [r[:3] for r in brute_near(given, 3, 90)]
    for hub, tile in ((4, 8), (10_000, 16)):
        monkeypatch.setattr(ngram_join, "HUB", hub)
        monkeypatch.setattr(ngram_join, "TILE", tile)
        got = ngram_join.similar_texts(documents(spark, given))
        assert rows(got, "doc_id", "n_shingles", "component_id") == want


def test_repeated_and_null_ids_and_empty_table(spark):
    text = prose(1, 50)
    docs = documents(spark, [(2, text), (2, text), (None, text), (None, "alone here"), (3, text + " more")])
    got = ngram_join.similar_texts(docs).collect()
    assert sorted(str((r["doc_id"], r["component_id"])) for r in got) == sorted(
        ["(2, 2)", "(2, 2)", "(None, 2)", "(None, None)", "(3, 2)"]
    )
    assert ngram_join.similar_texts(documents(spark, [])).count() == 0


def test_very_long_texts(spark):
    words = prose(5, 30_000, 5000).split()
    other = list(words)
    for k in range(0, 30_000, 100):
        other[k] = "changed"
    given = [(1, " ".join(words)), (2, " ".join(other)), (3, prose(6, 30_000, 5000))]
    want = [r[:3] for r in brute_near(given, 3, 90)]
    assert rows(ngram_join.similar_texts(documents(spark, given)), "doc_id", "n_shingles", "component_id") == want


def test_similar_sets_agree_in_a_group():
    generator = np.random.default_rng(3)
    for size in [*range(1, 60), 100, 333, 1000]:
        for _ in range(20):
            common = generator.integers(0, 1 << 63, size, dtype=np.uint64)
            most = 10 * size // 90  # differing members of a pair at the threshold
            split = generator.integers(0, most + 1)
            one = np.sort(np.append(common, generator.integers(0, 1 << 63, split, dtype=np.uint64)))
            other = np.sort(np.append(common, generator.integers(0, 1 << 63, most - split, dtype=np.uint64)))
            if len(one) == len(other) == size:
                continue  # equal sets are one class
            assert 100 * size >= 90 * (size + most)
            keys = [set(ngram_join._group_keys(s, 90).tolist()) for s in (one, other)]
            assert keys[0] & keys[1]


def test_tree_finds_what_all_pairs_find():
    generator = np.random.default_rng(4)
    base = generator.poisson(2, (40, 30))
    points = np.concatenate([base, base + generator.integers(0, 2, base.shape), generator.poisson(2, (300, 30)), base])
    sizes, labels = points.sum(axis=1), generator.integers(0, 60, len(points))
    for keep in (len(points), 9, 8, 2, 1, 0):
        tree = CountTree(points[:keep], sizes[:keep], labels[:keep])
        got = sorted(tuple(sorted(p)) for i, j in tree.pairs(80) for p in zip(i.tolist(), j.tolist()))
        want = [
            (i, j)
            for i in range(keep)
            for j in range(i + 1, keep)
            if labels[i] != labels[j]
            and np.minimum(points[i], points[j]).sum() >= least_common(sizes[i] + sizes[j], 80)
        ]
        assert got == want and (keep < 100 or want)
