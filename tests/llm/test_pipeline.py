from __future__ import annotations

import pytest

import corpus_pipeline
from tests.llm.helpers import prose
from tests.llm.test_scores import toxic_text
from versemill.llm.packing import ByteTokenizer, default_tokenizer


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of tables, and the ids that should stay after each stage."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = {i: toxic_text(i) for i in range(400)}
    toxic = {i for i in rows if i % 5 == 2}
    clean = sorted(set(rows) - toxic)
    copies = {1000 + k: rows[clean[k]].replace(" ", "  ") for k in range(30)}
    near = {2000 + k: rows[clean[50 + k]] + f" extra{k}" for k in range(20)}
    item = prose(777, 40)
    leaks = {3000 + k: prose(800 + k, 70) + " " + item.upper() + " " + prose(900 + k, 30) for k in range(10)}
    odd = {4000: "", 4001: None}
    documents = rows | copies | near | leaks | odd
    # no document of the repeated ids beyond the first should reach the next stage
    spark.createDataFrame(
        [(i, t, "en", "src", len(t or "")) for i, t in documents.items()],
        "doc_id long, text string, lang string, source string, n_chars long",
    ).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(
        [(i, 1, int(i in toxic)) for i in rows], "doc_id long, quality int, toxic int"
    ).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(778, 30))], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet"
    )
    stays = set(documents) - toxic
    after = {"toxicity": set(stays)}
    stays -= set(copies) | {4001}
    after["exact_dedup"] = set(stays)
    stays -= set(near)
    after["near_dedup"] = set(stays)
    stays -= set(leaks)
    after["decontamination"] = set(stays)
    return folder, documents, after


def test_each_stage_takes_effect_on_its_own_input(spark, corpus):
    folder, documents, after = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, folder)
        assert out.columns == docs.columns
        path = f"{folder}/after-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} == after[name]
        assert {r["doc_id"]: r["text"] for r in docs.collect()}.items() <= documents.items()


def test_run_packs_what_is_left(spark, corpus):
    folder, documents, after = corpus
    tokens = ByteTokenizer(default_tokenizer())
    found = corpus_pipeline.run(spark, folder).groupBy("doc_id").sum("length").collect()
    assert {r["doc_id"]: r["sum(length)"] for r in found} == {
        i: len(tokens.encode(documents[i] or "")) // 4 + 1 for i in after["decontamination"]
    }


def _tables(spark, folder, rows, labels, items):
    spark.createDataFrame(
        [(i, t, "en", "src", 0, "x", 1) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, toxicity string, row long",
    ).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_null_ids_repeated_rows_and_clashing_columns(spark, tmp_path):
    rows = [(k, prose(k, 40)) for k in range(30)]
    rows += rows[:5] + [(None, prose(600, 40)), (None, prose(601, 40)), (40, None), (41, ""), (42, prose(700, 30_000))]
    _tables(spark, str(tmp_path), rows, [(k, 1, 0) for k in range(30)] + [(None, 1, 1)], [(None, prose(601, 40)), (1, None)])
    found = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()
    ids = {r["doc_id"] for r in found}
    assert set(range(30)) | {42} <= ids and len(ids & {40, 41}) == 1


def test_empty_tables_give_no_rows(spark, tmp_path):
    _tables(spark, str(tmp_path), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
