from __future__ import annotations

import hashlib
import time
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import documents, prose
from versemill import staging
from versemill.llm import packing, suffix_dedup


def brute_repeats(given, length=50):
    first = {}
    order = lambda i: (i is None, i or 0)
    data = [(i, (t or "").encode()) for i, t in given]
    for i, text in data:
        for p in range(len(text) - length + 1):
            s = text[p : p + length]
            first[s] = min(first.get(s, order(i)), order(i))
    out = []
    for i, text in data:
        gone = [False] * len(text)
        for p in range(len(text) - length + 1):
            if first[text[p : p + length]] < order(i):
                gone[p : p + length] = [True] * length
        left = bytes(b for b, g in zip(text, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(text), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return sorted(map(str, out))


def repeat_corpus():
    passage, line = prose(1, 40), "This line is licensed under some license, version 3, and is long enough."
    given = [(k, prose(10 + k, 30) + " " + passage[k : 150 + k] + " " + prose(50 + k, 10)) for k in range(20)]
    given += [(40 + k, line + "\n" + prose(80 + k, 5) + "\n" + line) for k in range(6)]
    given += [(60, given[3][1]), (61, given[3][1][:49]), (62, given[3][1][:50]), (63, given[3][1][7:120])]
    given += [(70, "é" * 60), (71, "aé" + "é" * 40), (72, "z" * 300), (73, "z" * 49 + "y" + "z" * 80)]
    given += [(80, ""), (81, None), (None, passage), (None, passage + "!"), (82, passage + "?"), (82, passage + "?")]
    given += [(90, "x" * 20 + "\x00" * 60), (91, "\x00" * 55)]
    return given


def test_steps_leave_no_shuffle_files(spark, monkeypatch):
    written = []

    disk = spark._jsc.sc().env().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    alone = suffix_dedup._stage_alone

    def watched(*args):
        before = shuffles()
        made = alone(*args)
        end = time.monotonic() + 20  # files go in the background
        while shuffles() - before and time.monotonic() < end:
            time.sleep(0.1)
        written.append(shuffles() - before)
        return made

    monkeypatch.setattr(suffix_dedup, "_stage_alone", watched)
    given = [(k, prose(1, 60) + prose(k, 20)) for k in range(8)]
    assert suffix_dedup.remove_repeats(documents(spark, given)).where("n_removed > 0").count() == 7
    assert len(written) == 4 and not any(written)
    assert spark.conf.get(staging._FREE_SHUFFLES) == "false"



def test_repeats_equal_brute_force(spark):
    given = repeat_corpus()
    got = suffix_dedup.remove_repeats(documents(spark, given), with_text=True)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    found = got.collect()
    assert sorted(str(tuple(r[c] for c in columns)) for r in found) == brute_repeats(given)
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in found)


def test_frequent_grams_are_dealt_by_their_strings(spark, monkeypatch):
    split, dealt = suffix_dedup._split_ranks, []

    def spied(leads, length):
        dealt.append(leads.count())
        return split(leads, length)

    monkeypatch.setattr(suffix_dedup, "_split_ranks", spied)
    line = prose(1, 30)
    given = [(k, prose(100 + k, 3) + line[k % 7 :] + prose(500 + k, 3)) for k in range(120)]
    got = suffix_dedup.remove_repeats(documents(spark, given), stretches=4).collect()
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert dealt and dealt[0] > 0
    assert sorted(str(tuple(r[c] for c in columns)) for r in got) == brute_repeats(given)


def test_repeated_stretches_are_a_row_each():
    """However the grams are dealt, the rows of all parts are as many as the repeated stretches."""
    rng = np.random.default_rng(5)
    gram, key = rng.integers(0, 300, 2000), rng.integers(0, 50, 2000)
    texts = {g: len(set(key[gram == g])) for g in set(gram.tolist())}
    names = ["gram", "key1", "first"]
    rows = 0
    for parts in (1, 7, 64):
        made = []
        for part in range(parts):
            mine = np.flatnonzero(gram % parts == part)
            batch = pa.RecordBatch.from_arrays([pa.array(gram[mine]), pa.array(key[mine]), pa.array(mine.astype(np.int32))], names)
            made += [r for out in suffix_dedup._repeated(iter([batch])) for r in out.to_pylist()]
        assert sorted(r["first"] for r in made) == [i for i in range(2000) if texts[gram[i]] > 1]
        rows = rows or len(made)
        assert len(made) == rows


def test_repeats_in_one_text_only_and_empty_table(spark):
    got = suffix_dedup.remove_repeats(documents(spark, [(1, "w" * 500), (2, "v")])).collect()
    assert [r["n_removed"] for r in got] == [0, 0]
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0


def test_stretches_cover_every_window_once():
    texts = [prose(k, 30 + k).encode() for k in range(5)] + [b"short", b"", b"q" * 120]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = suffix_dedup.Stretches(data, offsets, 50)
    windows = [p for a, b in zip(found.first, found.last) for p in range(a, b + 1)]
    want = [o + p for o, t in zip(offsets, texts) for p in range(len(t) - 49)]
    assert windows == want


def test_levels_give_the_least_rank_and_grow_geometrically():
    generator = np.random.default_rng(0)
    levels, first = suffix_dedup.SuffixLevels(3), {}
    for batch in range(16):
        strings = np.array([bytes(r) for r in generator.integers(97, 101, (64, 3), dtype=np.uint8)], "S3")
        ranks = np.sort(generator.integers(batch * 10, batch * 10 + 10, 64))
        got = levels.add(strings, ranks)
        for s, r in zip(strings.tolist(), ranks.tolist()):
            first[s] = min(first.get(s, r), r)
        assert got.tolist() == [first[s] for s in strings.tolist()]
    sizes = [len(level[0]) for level in levels._levels]
    assert all(2 * b <= a for a, b in zip(sizes, sizes[1:]))


def brute_windows(lengths, window):
    room = []
    for length in sorted(lengths, reverse=True):
        fits = [(r, k) for k, r in enumerate(room) if r >= length]
        if fits:
            room[min(fits)[1]] -= length
        else:
            room.append(window - length)
    return len(room)


@pytest.mark.parametrize("window", [1, 7, 32])
def test_best_fit_decreasing_equals_brute_force(window):
    generator = np.random.default_rng(window)
    for _ in range(40):
        lengths = generator.integers(1, window + 1, generator.integers(0, 60)).tolist()
        windows, offsets = packing.best_fit_decreasing(lengths, window)
        assert len(set(windows)) == brute_windows(lengths, window)
        spans = {}
        for w, o, n in zip(windows, offsets, lengths):
            spans.setdefault(w, []).append((o, o + n))
        for some in spans.values():
            ends = [0] + [e for _, e in sorted(some)]
            assert [o for o, _ in sorted(some)] == ends[:-1] and ends[-1] <= window


def test_pack_is_an_exact_round_trip(spark):
    from tokenizers import Tokenizer

    given = [
        (1, prose(1, 900)), (2, ""), (3, None), (4, "tail <|endoftext|> end"), (5, "  two  spaces\n\n\tand　wide "),
        (6, "it's we'll 123 45!?\x85"), (6, "again"), (None, "none"), (7, "a" * 5000), (8, prose(2, 40)), (8, prose(2, 40)),
    ]
    found = packing.pack(documents(spark, given), window=256, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = sorted(str((i, tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in given)
    by_id = {}
    for r in sorted(found, key=lambda r: (str(r["doc_id"]), r["start"])):
        ids = array("I", bytes(r["ids"]))
        assert len(ids) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        by_id.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids.tolist()))
    whole = []
    for (i, total), parts in by_id.items():
        copies = sum(start == 0 for start, _ in parts)
        parts = parts[::copies]
        assert sum(len(p) for _, p in parts) == total
        whole += [str((i, [x for _, p in parts for x in p]))] * copies
    assert sorted(whole) == want
    ends = {}
    for r in found:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for some in ends.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(documents(spark, [])).count() == 0


def test_fast_ids_equal_the_tokenizer():
    import duckdb

    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    tokens = packing.ByteTokenizer(packing.default_tokenizer())
    slow = tokens._tokenizer.encode_batch(texts, add_special_tokens=False)
    assert all(tokens.encode(t) == array("I", s.ids).tobytes() for t, s in zip(texts, slow))
