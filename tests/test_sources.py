from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from versemill.operators.sampling import load_or_create_sample
from versemill.plans.topic_runs import in_pools
from versemill.sources import batches, logs
from versemill.sources import songs as source
from versemill.staging import new_path, scope, stage, with_row_index, work_dir


def test_csv_round_trip(spark, tmp_path):
    data = [
        (1, "T", 'A "q"', 1999, "rap", "en", "10", '{"A","B"}', ' line 1\nline "2", x \n'),
        (2, None, "b", None, None, None, None, "{}", None),
    ]
    df = spark.createDataFrame(data, source.SONG_SCHEMA)
    source.write_songs_csv(df, str(tmp_path / "csv"))
    assert source.read_songs_csv(spark, str(tmp_path / "csv")).orderBy("id").collect() == df.collect()


def test_parquet_modes(spark, tmp_path):
    path = str(tmp_path / "p")
    for _ in range(2):
        source.write_parquet(spark.range(3), path)
    assert source.read_parquet(spark, path).count() == 6
    source.write_parquet(spark.range(3), path, mode="overwrite")
    assert source.read_spread(spark, path).count() == 3


def test_row_index_is_consecutive(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(7)
    got = with_row_index(df, F.desc("x"), name="i", start=1)
    assert rows(got, "i", "x") == [(i, 1000 - i) for i in range(1, 1001)]


def test_row_index_of_nothing(spark):
    assert with_row_index(spark.range(0), "id").count() == 0


@pytest.fixture(scope="module")
def batch_path(spark):
    path = new_path(spark, "test-batches")
    batches.write_batches(spark.range(25).repartition(3), path, chunksize=10)
    return path


def test_batches(spark, batch_path):
    assert batches.batch_ids(spark, batch_path) == [1, 2, 3]
    assert rows(batches.load_batch(spark, batch_path, 3), "id") == [(i,) for i in range(20, 25)]
    with pytest.raises(ValueError):
        batches.load_batch(spark, batch_path, 4)


def test_random_batches(spark, batch_path):
    first = rows(batches.random_batches(spark, batch_path, 2, seed=1), "id")
    assert first == rows(batches.random_batches(spark, batch_path, 2, seed=1), "id")
    assert batches.random_batches(spark, batch_path, 3).count() == 25
    with pytest.raises(ValueError):
        batches.random_batches(spark, batch_path, 4)


def test_batches_built_on_first_use(spark):
    path = new_path(spark, "lazy-batches")
    got = batches.load_batch(spark, path, 1, source=spark.range(5), chunksize=2)
    assert rows(got, "id") == [(0,), (1,)]
    assert rows(batches.union_batches(got, batches.load_batch(spark, path, 3)), "id") == [(0,), (1,), (4,)]


@pytest.mark.parametrize("chunksize", [1, 3, 4, 10, 100])
def test_batches_with_repeated_and_null_ids(spark, chunksize):
    ids = [None] * 5 + [1, 2, 2, 2, 2, 2, 2, 2, 3, 5, 5, 8, 9, 9, 9, -4]
    df = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "id long, lyrics string").repartition(3)
    got = batches.split_batches(df, chunksize).collect()
    ordered = sorted(ids, key=lambda i: (i is not None, i or 0))
    want = sorted(str((i, k // chunksize + 1)) for k, i in enumerate(ordered))
    assert sorted(str((r.id, r.batch_id)) for r in got) == want
    assert sorted(r.lyrics for r in got) == sorted(f"text {k}" for k in range(len(ids)))


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 200])
def test_batches_of_every_count(spark, n):
    df = spark.range(n).withColumn("id", F.col("id") * 3 - 50)
    got = rows(batches.split_batches(df.repartition(3), 7), "id", "batch_id")
    assert got == [(3 * k - 50, k // 7 + 1) for k in range(n)]
    assert batches.split_batches(df.where("id > 1000"), 7).count() == 0


def test_batches_by_text_order(spark):
    names = ["b", "é", "a", None, "ab", "z", ""]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: r.batch_id for r in batches.split_batches(df, 2, "name").collect()}
    assert got == {None: 1, "": 1, "a": 2, "ab": 2, "b": 3, "z": 3, "é": 4}


def test_numbering_neither_sorts_nor_shuffles_texts(spark):
    path = new_path(spark, "ordered-songs")
    spark.range(1000).select("id", F.repeat(F.lit("la "), 50).alias("lyrics")).write.parquet(path)
    plan = batches.split_batches(spark.read.parquet(path), 100)._jdf.queryExecution().optimizedPlan().toString()
    outer = plan.split("scalar-subquery")[0]
    assert "lyrics" in outer and not any(word in outer for word in ("Sort", "Join", "Aggregate", "Repartition", "Window"))


def test_batch_folders(spark, batch_path):
    # a batch is read from its own folder: the file index holds no other
    files = batches.load_batch(spark, batch_path, 2).inputFiles()
    assert files and all("/batch_id=2/" in f for f in files)
    # input in order is written where it lies, input out of order is brought together first
    near, far = new_path(spark, "near"), new_path(spark, "far")
    batches.write_batches(spark.range(0, 1000, 1, 4), near, chunksize=100)
    batches.write_batches(spark.range(0, 1000, 1, 4).repartition(40), far, chunksize=100)
    for path, most in ((near, 2), (far, 1)):
        found = spark.read.parquet(path).groupBy("batch_id").agg(
            F.count("*").alias("n"), F.count_distinct("_metadata.file_path").alias("files")
        ).collect()
        assert sorted(r.batch_id for r in found) == list(range(1, 11))
        assert all(r.n == 100 and r.files <= most for r in found)


def test_training_log(spark, tmp_path):
    lines = ["noise 1.5", "x -7.812 per-word bound, 224.7 perplexity estimate", "--8.0 per-word b, 3.5 perplexity", "tail"]
    (tmp_path / "a.log").write_text("\n".join(lines))
    (tmp_path / "b.log").write_text("y -6.5 per-word bound, 90.5 perplexity estimate based on 3 documents\n" * 60)
    got = logs.training_log_metrics(spark, str(tmp_path))
    assert rows(got)[:3] == [(1, -7.812, 224.7), (2, None, 3.5), (3, -6.5, 90.5)]
    last = logs.last_metrics(got).collect()
    assert [r.seq for r in last] == list(range(13, 63))


def test_sample_is_created_once(spark):
    path, calls = new_path(spark, "sample"), []

    def create():
        calls.append(1)
        return spark.range(4)

    for _ in range(2):
        assert load_or_create_sample(spark, path, create).count() == 4
    assert calls == [1]


def test_staged_tables_go_with_their_scope(spark):
    outside = stage(spark.range(3), "outside")
    with scope() as made:
        inside = stage(spark.range(5), "inside")
        with scope() as inner:
            kept = inner.keep(new_path(spark, "kept"))
            spark.range(7).write.parquet(kept)
            gone = stage(spark.range(2), "gone")
            path = inner.paths[-1]
            assert gone.count() == 2
        assert not source.path_exists(spark, path) and source.path_exists(spark, kept)
        assert inside.count() == 5
        paths = list(made.paths)
        assert len(paths) == 1
    assert not source.path_exists(spark, paths[0])
    assert outside.count() == 3
    with pytest.raises(ZeroDivisionError):
        with scope() as made:
            stage(spark.range(1), "failed")
            paths = list(made.paths)
            1 / 0
    assert not source.path_exists(spark, paths[0])


def test_threads_stage_within_the_callers_scope(spark):
    with scope() as made:
        in_pools(spark.range(1), {f"p{i}": lambda: stage(spark.range(1), "pooled").count() for i in range(4)}, 2)
        assert len(made.paths) == 4


def test_work_dir_is_stable(spark):
    assert work_dir(spark) == work_dir(spark)
