from __future__ import annotations

import hashlib
import zlib

import pytest

from versemill.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, hash string, path string"


def frame(spark, given):
    return spark.createDataFrame([(*row, "t", "h", "p") for row in given], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def lowered(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def climb(hashes, fanout):
    """Root, and the (left, right) pairs of each leaf on its way up."""
    steps, level, places = [[] for _ in hashes], list(hashes), list(range(len(hashes)))
    while len(level) > 1:
        runs = [level[k : k + fanout] for k in range(0, len(level), fanout)]
        for i, p in enumerate(places):
            run, own = runs[p // fanout], p % fanout
            steps[i].append(("".join(run[:own]), "".join(run[own + 1 :])))
        places = [p // fanout for p in places]
        level = [sha("".join(r)) for r in runs]
    return level[0], steps


def brute(given, fanout):
    trees = {}
    for row in given:
        i, source, lang, n, text = row
        key = (source is not None, (source or "").encode())
        changed = lowered(text) if zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0 else text
        trees.setdefault(key, []).append(
            ((i is not None, i or 0), leaf(i, source, lang, n, text), leaf(i, source, lang, n, changed), i)
        )
    found, subroots = [], []
    for key in sorted(trees):
        rows = sorted(trees[key], key=lambda r: r[:3])
        subroot, steps = climb([r[1] for r in rows], fanout)
        subroots.append(subroot)
        found.append((subroot, rows, steps))
    root, tops = climb(subroots, fanout)
    out = []
    for (subroot, rows, steps), top in zip(found, tops):
        for (_, digest, changed, i), path in zip(rows, steps):
            folded = changed
            for left, right in path + top:
                folded = sha(left + folded + right)
            proof = sha("".join(x + y for x, y in path + top))
            out.append((i, digest, subroot, root, proof, folded, folded == root))
    return sorted(map(str, out))


def corpus():
    given = [(k, "big", "en", k, f"Text {k} Of THE source") for k in range(1, 90)]
    given += [(k, f"s{k % 20}", None if k % 3 else "de", None, f"tExt {k}") for k in range(200, 260)]
    given += [(300, None, None, None, None), (301, None, "fr", 3, "Éa B"), (302, "", "en", 0, ""), (303, "é", "en", 1, "A")]
    given += [(None, "big", "en", 1, "NULL id"), (None, "big", "en", 1, "other NULL"), (7, "big", "en", 9, "again")]
    given += [(8, "big", "en", 8, "Text 8 Of THE source")] * 3 + [(400, "long", "en", 1, "Ab " * 100_000)]
    return given


@pytest.mark.parametrize("fanout", [2, 16])
def test_manifest_equals_brute_force(spark, fanout):
    given = corpus()
    got = merkle.verify_tampered(frame(spark, given), fanout=fanout)
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == brute(given, fanout)


def test_manifest_tells_tampered_rows(spark):
    given = [(k, "s", "en", 1, "UPPER" if k % 2 else "lower") for k in range(60)]
    got = {r["doc_id"]: r["verified"] for r in merkle.verify_tampered(frame(spark, given)).collect()}
    wrong = {k for k in range(60) if k % 2 and zlib.crc32(str(k).encode()) % 5 == 0}
    assert wrong and {k for k, ok in got.items() if not ok} == wrong


def test_manifest_of_one_row_and_of_none(spark):
    one = merkle.verify_tampered(frame(spark, [(5, "s", "en", 1, "x")])).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == sha("") and one["verified"]
    assert merkle.verify_tampered(frame(spark, [])).count() == 0
    assert merkle.build_manifest(frame(spark, [])).root is None


def test_intervals_of_a_level_cover_every_leaf_once(spark):
    manifest = merkle.build_manifest(frame(spark, corpus()), fanout=4)
    for family in manifest.families:
        for row in family.collect():
            edges = [(c["lo"], c["hi"]) for c in row["children"]]
            assert edges[0][0] == row["lo"] and edges[-1][1] == row["hi"] and len(edges) <= 4
            assert all(a[1] == b[0] for a, b in zip(edges, edges[1:]))
