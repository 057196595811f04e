from __future__ import annotations

from pyspark.sql import functions as F

from tests.llm.helpers import documents, prose
from versemill.llm import decontamination, minhash, toxicity
from versemill.llm.common import add_columns


def renamed(spark, given):
    """The ids in a column of another name, beside a ``doc_id`` that means something else."""
    return documents(spark, given).withColumnRenamed("doc_id", "number").withColumn("doc_id", F.lit("other"))


def test_near_duplicates_by_another_id_column(spark):
    text = prose(1, 60)
    docs = renamed(spark, [(1, text), (2, text + " more"), (3, prose(2, 60)), (None, None)])
    got = minhash.drop_near_duplicates(docs, id_col="number")
    assert got.columns == docs.columns
    assert sorted(str((r["number"], r["doc_id"])) for r in got.collect()) == ["(1, 'other')", "(3, 'other')", "(None, 'other')"]


def test_contaminated_by_another_id_column(spark):
    passage = prose(5, 30)
    docs = renamed(spark, [(1, prose(6, 80) + " " + passage), (2, prose(7, 80)), (None, "")])
    items = spark.createDataFrame([(9, passage)], "item_id long, text string")
    got = decontamination.drop_contaminated(docs, items, id_col="number")
    assert got.columns == docs.columns
    assert sorted(str(r["number"]) for r in got.collect()) == ["2", "None"]


def test_new_columns_replace_those_of_their_name(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    got = add_columns(docs, lambda texts: {"score": [len(t) for t in texts]}, "score long")
    assert got.columns == [*(c for c in docs.columns if c != "score"), "score"]
    assert sorted((r["doc_id"], r["score"]) for r in got.collect()) == [(1, 3), (2, 0)]


def test_scores_beside_columns_of_their_name(spark):
    docs = documents(spark, [(1, "fine words"), (2, "")]).withColumn("toxicity", F.lit("x")).withColumn("toxic_spans", F.lit("y"))
    got = toxicity.score_toxicity(docs, toxicity.ToxicityModel())
    assert dict(got.dtypes)["toxicity"] == "double" and got.columns.count("toxicity") == 1
    assert all(r["toxicity"] < 0.5 for r in got.collect())
