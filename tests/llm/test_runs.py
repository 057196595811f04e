from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given as over
from hypothesis import settings
from hypothesis import strategies as st

from tests.llm.helpers import documents, prose
from versemill.llm import lce, runs


def brute_runs(words):
    """All maximal stretches of a smallest period, by comparing every word with every one after it."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        start = 0
        while start + q < len(words):
            end = start
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end + q - start >= max(6, 4 * q):
                found.setdefault((start, end + q - start), q)
            start = end + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def brute(given, probe=True):
    out = []
    for i, text in given:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(b"" if i is None else str(i).encode())
        n, g = len(words), h // 10
        if probe and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        found = brute_runs(words)
        gone = {k for s, m, q in found for k in range(s + q, s + m)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out.append(
            (i, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else [None] * 4),
             sha("".join(f"{s},{m},{q}\n" for s, m, q in found)),
             sha(" ".join(w for k, w in enumerate(words) if k not in gone)))
        )
    return sorted(map(str, out))


COLUMNS = (
    "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256",
)


@settings(max_examples=300, deadline=None)
@over(st.lists(st.integers(1, 3), max_size=60))
def test_runs_of_small_alphabets(symbols):
    want = brute_runs(symbols)
    assert runs.find_runs(np.array(symbols, np.int64)).tolist() == [list(r) for r in want]
    assert runs.word_runs(np.array(symbols, np.int64)).tolist() == [list(r) for r in want]


@settings(max_examples=100, deadline=None)
@over(st.lists(st.integers(1, 4), min_size=1, max_size=40))
def test_extensions_and_orders(symbols):
    made = lce.Extensions(np.array(symbols, np.int64))
    size = len(symbols)
    pairs = [(a, b) for a in range(size + 1) for b in range(size + 1) if a != b]
    got = made.common(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])).tolist()
    for (a, b), n in zip(pairs, got):
        one, two = symbols[a:], symbols[b:]
        assert one[:n] == two[:n] and (n == min(len(one), len(two)) or one[n] != two[n])
    for falling in (False, True):
        order = sorted(range(size + 1), key=lambda k: [-s if falling else s for s in symbols[k:]])
        ranks = made.ranks(falling)
        assert [ranks[k] for k in order] == list(range(size + 1))


def test_runs_of_long_powers():
    for root, times in (([1], 5000), ([1, 2, 1], 3000), (list(range(1, 900)), 4), ([1, 1, 2], 7)):
        symbols = np.array([1000, *(root * times), 1001])
        got = runs.find_runs(symbols).tolist()
        assert [1, len(root) * times, len(root)] in got
    assert runs.find_runs(np.array([1, 2, 3] * 3 + [1, 2])).tolist() == []


def corpus():
    random.seed(3)
    given = [(k, prose(k, 5 + 7 * k, 40)) for k in range(40)]
    given += [(100 + k, prose(k, 30) + " la" * k + " " + "do re mi " * (k % 6) + prose(k, 9)) for k in range(20)]
    line = prose(77, 9)
    given += [(200 + k, "\n".join([line] * k + [prose(k, 4)] + [line] * 5)) for k in range(8)]
    given += [(300, ""), (301, None), (302, " \t\n"), (303, "one"), (304, "a a a a a"), (305, "a a a a a a")]
    given += [(306, "É é " * 4), (None, "x y " * 9), (None, None), (307, "a b " * 6), (308, "w " * 20_000)]
    given += [(305, "a a a a a a"), (305, "a a a a a a"), (309, " ".join(random.choices("ab", k=900)))]
    return given


@pytest.mark.parametrize("probe", [True, False])
def test_periodic_runs_equal_brute_force(spark, probe):
    given = [(i, t) for i, t in corpus() if i != 308]
    got = runs.periodic_runs(documents(spark, given), probe=probe)
    assert sorted(str(tuple(r)) for r in got.select(*COLUMNS).collect()) == brute(given, probe)


def test_periodic_runs_of_a_long_text_and_of_none(spark):
    row = runs.periodic_runs(documents(spark, [(308, "w " * 20_000)])).first()
    assert (row["n_runs"], row["start"], row["length"], row["period"]) == (1, 0, 20_000, 1)
    assert runs.periodic_runs(documents(spark, [])).count() == 0
