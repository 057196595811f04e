from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import rows
from tests.llm.helpers import documents, prose
from versemill.llm import exact_dedup, minhash
from versemill.llm.common import BATCH_BYTES, plain_letters, word_hashes
from versemill.llm.components import connected_components

EDGE = [
    (5, "a  b"), (3, "a b"), (9, "a\tb"), (7, " a b"), (1, None), (2, ""), (None, "a b"),
    (4, "x"), (4, "x"), (6, "x"), (8, "y" * 200_000), (10, "y" * 200_000), (None, None), (4, "other"),
]


def brute_exact(given):
    found = {}
    for i, text in given:
        found.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(i)
    out = []
    for text, ids in found.items():
        first = min((i is None, i or 0) for i in ids)
        keep = None if first[0] else first[1]
        kept = False
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            out.append((i, keep, len(ids), i == keep and not kept, hashlib.sha256(text.encode()).hexdigest()))
            kept = kept or i == keep
    return sorted(map(str, out))


@pytest.mark.parametrize("bits", [1 << 24, 1 << 15])
def test_exact_groups_equal_brute_force(spark, bits):
    got = exact_dedup.exact_groups(documents(spark, EDGE), digests=True, filter_bits=bits)
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == brute_exact(EDGE)


def test_exact_without_digests_hashes_survivors_only(spark):
    got = {r["doc_id"]: r["text_sha256"] for r in exact_dedup.exact_groups(documents(spark, EDGE[:4])).collect()}
    assert got[3] and got[5] and got[9] and got[7] is None


def test_exact_drop_keeps_columns_and_one_of_each(spark):
    docs = documents(spark, EDGE)
    got = exact_dedup.drop_exact_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(["3", "7", "1", "4", "8", "4"])


def test_exact_empty_table(spark):
    assert exact_dedup.exact_groups(documents(spark, [])).count() == 0
    assert exact_dedup.drop_exact_duplicates(documents(spark, [])).count() == 0


def brute_near(given, size, percent):
    sets = []
    for _, text in given:
        words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        n = min(size, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    component = list(range(len(given)))
    for a in range(len(given)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                old, new = component[a], component[b]
                component = [new if c == old else c for c in component]
    out = []
    for a, (i, _) in enumerate(given):
        least = min(given[b][0] for b in range(len(given)) if component[b] == component[a])
        out.append((i, len(sets[a]), least, i == least))
    return sorted(out)


def near_corpus():
    given, number = [], 0
    for family in range(6):
        base = prose(family, 120 + 60 * family).split()
        for copy in range(12):
            words = list(base)
            for k in range(copy):  # from exact copies to far ones
                words[(k * 37 + copy * 11) % len(words)] = f"new{family}x{copy}x{k}"
            given.append((1000 - number, " ".join(words)))
            number += 1
    passage = prose(99, 60)
    given += [(2000 + k, prose(200 + k, 25 + k) + " " + passage) for k in range(25)]
    given += [(3000, ""), (3001, None), (3002, " \t "), (3003, "one two"), (3004, "ONE two"), (3005, "One")]
    return given


@pytest.mark.parametrize("words", [4, 5])
def test_near_components_equal_brute_force(spark, words):
    given = near_corpus()
    got = minhash.near_duplicates(documents(spark, given), words=words)
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == brute_near(given, words, 80)


def test_near_group_around_the_threshold(spark):
    # edited copies whose pairs lie just below and just above the threshold
    base, given = prose(41, 300, 4000).split(), []
    generator = random.Random(7)
    for copy in range(90):
        words = list(base)
        for k in generator.sample(range(300), 4 + copy % 4):
            words[k] = f"edit{copy}x{k}"
        given.append((copy, " ".join(words)))
    want = brute_near(given, 4, 80)
    got = minhash.near_duplicates(documents(spark, given), words=4)
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == want
    assert 1 < len({r[2] for r in want}) < 90


def test_near_repeated_and_null_ids(spark):
    text = prose(1, 50)
    docs = documents(spark, [(2, text), (2, text), (None, text), (None, "alone here"), (3, text + " more")])
    got = minhash.near_duplicates(docs).collect()
    assert sorted(str((r["doc_id"], r["component_id"])) for r in got) == sorted(
        ["(2, 2)", "(2, 2)", "(None, 2)", "(None, None)", "(3, 2)"]
    )
    assert sum(r["kept"] for r in got) == 2


def test_near_drop_and_empty_table(spark):
    given = near_corpus()
    docs = documents(spark, given)
    got = minhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    want = sorted(i for i, _, _, kept in brute_near(given, 5, 80) if kept)
    assert sorted(r["doc_id"] for r in got.collect()) == want
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


def test_word_hashes_follow_the_words():
    texts = ["Ab  c\x0bAB", "", None, "é x", "c", "ab" * 5000 + " ab"]
    hashes, firsts = word_hashes(pa.array(texts), plain_letters())
    words = [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())]
    assert len(hashes) == len(words) == firsts[-1]
    assert len(set(hashes.tolist())) == len(set(words))
    assert len(set(zip(hashes.tolist(), words))) == len(set(words))
    assert np.diff(firsts).tolist() == [3, 0, 0, 1, 1, 2]


def test_sequential_test_keeps_pairs_at_the_threshold():
    generator = np.random.default_rng(5)
    kept = 0
    for _ in range(2000):
        same = generator.random(150) < 0.8
        steps = [(n, minhash.least_matches(n, 0.8, minhash.MISS)) for n in range(30, 151, 30)]
        kept += all(same[:n].sum() >= least for n, least in steps)
    assert kept == 2000
    assert minhash.least_matches(150, 0.8, 1e-6) > 75


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 540)] + [(9, 9)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got.values()) == {100, 500} and len(got) == 61 + 40


def test_batches_of_near_duplicates_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, str(64 << 20))
        minhash.near_duplicates(documents(spark, [])).count()
        assert int(spark.conf.get(name)) == BATCH_BYTES
    finally:
        spark.conf.set(name, before)
