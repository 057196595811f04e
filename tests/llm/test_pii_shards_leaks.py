from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

from tests.llm.helpers import documents, prose
from versemill.llm import decontamination, pii, sharding, svd

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        twice = int(c) * (1 + k % 2)
        total += twice - 9 * (twice > 9)
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute_spans(text):
    found = [
        (m.start(), k, f"{kind}:{m.start()}:{m.end()}")
        for k, (kind, pattern) in enumerate(PATTERNS.items())
        for m in re.finditer(pattern, text or "")
        if valid(kind, m[0])
    ]
    return [s for _, _, s in sorted(found)]


TEXTS = [
    "mail a.b@c.de, x@y, é@z.org and u%v+w-@sub.do-main.co.uk. a@b.c@d.e",
    "ip 1.2.3.4 and 256.1.1.1 then 1.2.3.4.5.6.7.8 and 001.02.3.255 1.2.3",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 378282246310005 5 0000 0000 0000",
    "call +49 (30) 1234-567 or +1 22 or +12345678901234567 +4930123456.",
    "\x01 a@b.cc \x01 +49 30 123456\x02 7", "", None, "a" * 100_000, "1 " * 50_000, "a." * 30_000 + "@", "x@" + "a." * 30_000 + "a",
    "+" + "(" * 20_000, "\U0001f600 q@r.st \U0001f600 10.0.0.1",
]


def test_base_spans_equal_brute_force(spark):
    given = list(enumerate(TEXTS)) + [(0, TEXTS[0]), (None, TEXTS[1])]
    docs = documents(spark, given)
    for r in pii.digest(pii.find_personal_data(docs)).collect():
        want = brute_spans(TEXTS[1 if r["doc_id"] is None else r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), r["doc_id"]
        assert r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == len(want)
    assert pii.digest(pii.find_personal_data(documents(spark, []))).count() == 0


def test_terms_that_disclose_are_marked_and_taken_out(spark):
    given = [(k, f"{prose(k, 20)} the zeppelin captain wrote to ann@ship.org about {prose(50 + k, 8)} common words") for k in range(4)]
    given += [(10 + k, f"common words of captain number {k} and {prose(70 + k, 20)}") for k in range(30)]
    found = {r["doc_id"]: r for r in pii.sanitise(pii.find_personal_data(documents(spark, given))).collect()}
    for k in range(4):
        terms = {found[k]["text"][s["start"] : s["end"]] for s in found[k]["spans"] if s["kind"] == "term"}
        assert "zeppelin" in terms and "common" not in terms and "captain" not in terms
        assert "ann@ship.org" not in found[k]["sanitised"] and "<EMAIL>" in found[k]["sanitised"]
        assert "zeppelin" not in found[k]["sanitised"]
    assert all(found[10 + k]["sanitised"] == found[10 + k]["text"] for k in range(30))


def _terms(row):
    return {row["text"][s["start"] : s["end"]] for s in row["spans"] if s["kind"] == "term"}


def test_entities_of_one_or_two_texts_have_terms(spark):
    given = [(0, "common words, the zeppelin captain is ann@ship.org"), (3, "common words of the captain")]
    given += [(k, f"common words {k}, the baroness of harlow is +49 30 1234567") for k in (1, 2)]
    given += [(10 + k, f"common words, the captain of {prose(k, 40)} is c{k}@post.com") for k in range(40)]
    given += [(60 + k, f"common words of {prose(60 + k, 40)}") for k in range(60)]
    found = {r["doc_id"]: r for r in pii.find_personal_data(documents(spark, given + given[:1] * 5)).collect()}
    assert _terms(found[0]) == {"zeppelin"}
    assert _terms(found[1]) == _terms(found[2]) == {"baroness", "harlow"}
    assert not any({"common", "words", "captain"} & _terms(r) for r in found.values())


def test_terms_of_any_length_and_distance_in_all_texts(spark):
    far = " ".join(["common words"] * 20)
    given = [(k, f"ann@ship.org {far} Kim Li 王小明 {far}") for k in range(3)] + [(3, "Kim. common words"), (4, "王小明和 Li")]
    given += [(10 + k, f"common words {prose(k, 40)}") for k in range(60)]
    found = {r["doc_id"]: r for r in pii.find_personal_data(documents(spark, [(k, f"{t} {prose(k, 30)}") for k, t in given])).collect()}
    for k in range(3):
        assert {"Kim", "Li", "王小明"} <= _terms(found[k]) and not {"common", "words"} & _terms(found[k])
    assert "Kim" in _terms(found[3]) and {"王小明", "Li"} <= _terms(found[4])


def test_no_python_in_the_plan(spark):
    plan = pii.find_personal_data(documents(spark, [(1, "a@b.cc")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


def test_shards_are_even_and_keep_equal_texts(spark):
    given = [(k, prose(k, 20 + k % 60)) for k in range(900)]
    given += [(2000 + 10 * k + c, f"group {k} " + prose(k, 30)) for k in range(40) for c in range(2 + k % 4)]
    given += [(5000 + k, "giant " + prose(1, 20)) for k in range(300)]
    given += [(7000, None), (7001, ""), (None, "x"), (3, given[3][1]), (3, given[3][1])]
    found = sharding.shard_documents(documents(spark, given), shards=8).collect()
    assert len(found) == len(given)
    sizes, slots, groups = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in found:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        groups[r["text_crc32"], r["size"]].add(r["shard"])
    assert set(sizes) == set(range(8))
    assert max(sizes.values()) - min(sizes.values()) < 600
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = dict(given)
    assert all(
        r["size"] == len((text[r["doc_id"]] or "").encode()) + 16
        and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode())
        for r in found
    )
    giant = zlib.crc32(given[-6][1].encode()) if given[-6][0] >= 5000 else None
    split = [k for k, s in groups.items() if len(s) > 1]
    assert all(k[0] == giant for k in split) and len(split) <= 1
    assert sharding.shard_documents(documents(spark, []), shards=8).count() == 0


def test_singular_vectors_equal_numpy(spark):
    generator = np.random.default_rng(2)
    dense = np.zeros((60, 40))
    for row in dense:
        row[generator.choice(40, 6, replace=False)] = generator.random(6)
    given = [([int(i) for i in np.flatnonzero(r)], [float(x) for x in r[np.flatnonzero(r)]]) for r in dense] + [([], [])]
    matrix = spark.createDataFrame(given, "features array<int>, weights array<float>").repartition(3)
    vectors, values = svd.right_singular_vectors(matrix, 40, 5, oversampling=20, rounds=4)
    left, want, right = np.linalg.svd(dense)
    assert np.allclose(values, want[:5], rtol=1e-3)
    assert np.allclose(np.abs(np.sum(vectors * right[:5].T, axis=0)), 1, atol=1e-2)


def test_common_subsequence_equals_dynamic_programming():
    generator = np.random.default_rng(4)
    for _ in range(60):
        a, b = (generator.integers(0, 6, generator.integers(0, 20)).tolist() for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontamination.common_subsequence(a, b) == table[-1, -1]


def _planted(share, count=60, seed=11):
    """Passages, and texts that hold one each with a share of its words replaced by others of the corpus."""
    generator = np.random.default_rng(seed)
    items = [prose(5000 + k, 15 + k % 44) for k in range(count)]
    texts = []
    for k, item in enumerate(items):
        words, other = item.split(), prose(7000 + k, 60).split()
        words = [other[i] if generator.random() < share else w for i, w in enumerate(words)]
        texts.append(f"{prose(8000 + k, 5 + 7 * (k % 20))} {' '.join(words)} {prose(9000 + k, 90)}")
    return items, texts


def _brute(items, texts):
    """Pairs that pass the checks at any place of a text, without a latent space."""
    cut = [re.findall(r"[^\W_]+", i.lower()) for i in items]
    held = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    frequency = defaultdict(int)
    for words in held:
        for word in set(words):
            frequency[word] += 1
    found = set()
    for i, item in enumerate(cut):
        weight = {w: np.float32(np.log((len(texts) + 2) / (frequency[w] + 1))) for w in item}
        ranks = {w: (-weight[w], n) for n, w in enumerate(sorted(set(item)))}
        answer = set(sorted(ranks, key=ranks.get)[:4])
        for t, words in enumerate(held):
            for at in range(0, max(1, len(words) - len(item)), 4):
                around = words[max(0, at - len(item)) : at + 2 * len(item)]
                if 2 * len(answer & set(around)) >= len(answer):
                    if decontamination.common_subsequence(item, around) >= 0.65 * len(item):
                        found.add((t, i))
    return found


def test_recall_of_the_whole_query_by_share_of_replaced_words(spark):
    for share, least in ((0.0, 1.0), (0.1, 0.99), (0.2, 0.95), (0.3, 0.9)):
        items, texts = _planted(share)
        benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
        found = decontamination.find_contamination(documents(spark, list(enumerate(texts))), benchmark)
        got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
        pairs = {(k, k) for k in range(len(items))}
        passing = _brute(items, texts) & pairs
        assert len(got & passing) >= least * len(passing), share
        assert share > 0 or got >= pairs


def test_cosine_prunes_by_an_order_of_magnitude(spark):
    items, texts = _planted(0.0)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontamination.read_documents(documents(spark, list(enumerate(texts))))
    block = decontamination.read_passages(decontamination.read_documents(benchmark, "item_id", "text"), "doc_id")
    passages = decontamination.Passages.read(block)
    space = decontamination.fit_latent_space(rows, block, passages)
    hashes, firsts = decontamination.word_hashes(
        decontamination.pa.array(texts), decontamination.alphanumeric_letters(), single=True
    )
    words = passages.vocabulary.number(hashes)
    count = [
        sum(len(found[1]) for found in decontamination._Searcher(passages, space, least).near(words, firsts))
        for least in (-1.1, decontamination.LEAST_COSINE)
    ]
    assert count[1] * 10 <= count[0]


def test_short_items_and_scripts_without_spaces(spark):
    capital, chinese = "What is the capital city of France", "王小明昨天在北京大学图书馆里读完了一本很厚的书"
    items = [(1, capital), (2, chinese), (3, "Thames"), (4, "书")]
    given = [(k, prose(k, 60)) for k in range(40)]
    given += [(50, f"{prose(1, 30)} what is the CAPITAL city of france? {prose(2, 9)}"), (51, f"我说{chinese[:10]}也{chinese[11:]}。")]
    given += [(52, "the capital city of what is france"), (53, "the thames"), (54, "Thameside"), (55, "what is the capital city"), (56, "of France")]
    found = decontamination.find_contamination(documents(spark, given), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(50, 1), (51, 2), (51, 4), (53, 3)}


def test_blocks_of_passages_give_the_same_rows(spark, monkeypatch):
    items, texts = _planted(0.1, count=60)
    items += items[:3]  # equal texts under other ids
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = documents(spark, list(enumerate(texts)))
    pairs = [decontamination.find_contamination(docs, benchmark).select("doc_id", "item_id").collect()]
    monkeypatch.setattr(decontamination, "BLOCK_PASSAGES", 20)
    pairs.append(decontamination.find_contamination(docs, benchmark).select("doc_id", "item_id").collect())
    assert len(pairs[0]) >= 63 and sorted(pairs[0]) == sorted(pairs[1])


def test_leaks_are_found_and_clean_documents_left(spark):
    items = [(k, prose(1000 + k, 12 + 3 * k)) for k in range(20)] + [(50, None), (51, ""), (52, "two words"), (None, prose(909, 30))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    given = [(k, prose(k, 80 + k)) for k in range(120)]
    for k in range(20):
        words = items[k][1].split()
        if k % 2:  # a paraphrase: some words changed, case and punctuation differ
            words[len(words) // 2] = "other"
            words = [w.upper() + "," for w in words]
        given.append((500 + k, prose(300 + k, 13 * k) + " " + " ".join(words) + " " + prose(400 + k, 150)))
    given += [(600, None), (601, ""), (602, items[15][1]), (602, items[15][1]), (603, prose(77, 20_000) + " " + items[9][1])]
    docs = documents(spark, given)
    found = decontamination.find_contamination(docs, benchmark)
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got == {(500 + k, k) for k in range(20)} | {(602, 15), (603, 9)}
    kept = decontamination.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [*range(120), 600, 601]
    nothing = benchmark.limit(0)
    assert decontamination.find_contamination(docs, nothing).count() == 0
    assert decontamination.find_contamination(documents(spark, []), benchmark).count() == 0
