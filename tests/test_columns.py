from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.conftest import rows
from versemill.operators import artists, columns, profile, stats
from versemill.plans import etl


def years(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "year long")


def test_repair_two_digit_year(spark):
    df = years(spark, 2000, 9, 71, 23, 24, 2023, 101, 0, 99, None)
    got = [r[0] for r in df.select(columns.repair_two_digit_year(F.col("year"))).collect()]
    assert got == [2000, 2009, 1971, 2023, 1924, 2023, 101, 2000, 1999, None]


@pytest.mark.parametrize("bad", [100, -1, 2024])
def test_repair_rejects_or_nulls(spark, bad):
    df = years(spark, bad)
    assert df.select(columns.repair_two_digit_year(F.col("year"), strict=False)).first()[0] is None
    with pytest.raises(PySparkException):
        df.select(columns.repair_two_digit_year(F.col("year"))).collect()


def test_year_bounds(spark):
    df = years(spark, 1959, 1960, 1961, 2023, 2024, 2025, None)
    assert rows(columns.filter_year_range(df)) == [(1961,), (2023,), (2024,)]
    assert rows(columns.filter_year_range(df, include_low=True)) == [(1960,), (1961,), (2023,), (2024,)]
    assert rows(columns.filter_year_range(df, 1960, 2023, include_low=True, include_high=False)) == [(1960,), (1961,)]


def test_decade(spark):
    assert [r.decade for r in columns.add_decade(years(spark, 1999, 2000, 7, None)).collect()] == [1990, 2000, 0, None]


def test_clean_features(spark):
    df = spark.createDataFrame([(v,) for v in [None, "{}", "{A}", '{"A","B;C"}', "a}b{"]], "features string")
    got = [r[0] for r in df.select(columns.clean_features(F.col("features"))).collect()]
    assert got == [None, [""], ["A"], ["A", "B;C"], ["a}b{"]]


def test_cast_views_and_dollar(spark):
    df = spark.createDataFrame([("12", "A$AP"), ("x", "$"), (None, None)], "views string, artist string")
    assert [r.views for r in columns.cast_views(df).collect()] == [12, None, None]
    assert [r[0] for r in df.select(columns.strip_dollar(F.col("artist"))).collect()] == ["AAP", "", None]


def test_filters_drop_nulls(spark):
    df = spark.createDataFrame([("rap", "Genius x"), ("misc", "b"), (None, None), ("pop", "c")], "tag string, artist string")
    assert rows(columns.filter_genre(df, drop="misc"), "tag") == [("pop",), ("rap",)]
    assert rows(columns.drop_artist_prefix(df), "artist") == [("b",), ("c",)]


def test_unknown_decade(spark):
    df = columns.add_decade(years(spark, 1965))
    with pytest.raises(ValueError):
        columns.filter_decades(df, [1970], 1960)


def test_genre_decade_accepts_text(spark):
    df = spark.createDataFrame([(1, "rap", 2010, "x"), (2, "pop", 2010, "y")], "id long, tag string, decade int, lyrics string")
    assert rows(columns.filter_genre_decade(df, "rap", "2010")) == [(1, "x")]


def test_replace_column_keeps_old_value(spark):
    df = spark.createDataFrame([("a", "b"), ("c", None)], "lyrics string, new string")
    assert rows(columns.replace_column(df, "lyrics", F.col("new")), "lyrics") == [("b",), ("c",)]


def featured(spark):
    data = [
        ("1", "a", 3, ["X", "Y;Z"]),
        ("1", "a", 3, ["X", "Y;Z"]),
        ("1", "a", 3, ["X"]),
        ("2", "b", 1, [""]),
        ("3", "c", 1, None),
    ]
    return spark.createDataFrame(data, "artist_id string, artist_name string, num_songs long, features array<string>")


def test_distinct_arrays_not_elements(spark):
    got = artists.artist_features(featured(spark)).collect()
    assert [(r.artist_id, r.features, r.num_features) for r in got] == [("1", ["X", "X", "Y;Z"], 3)]


def test_feature_rows(spark):
    out = artists.feature_display_name(artists.explode_features(artists.artist_features(featured(spark))))
    assert rows(out, "artist_id", "feature_name") == [("1", "X"), ("1", "X"), ("1", "Y Z")]


def test_exploded_rows_carry_no_array(spark):
    sets = artists.artist_feature_sets(featured(spark))
    whole = artists.explode_features(artists.artist_features(featured(spark)))
    out = artists.explode_features(sets)
    assert rows(out, "artist_id", "feature_name") == rows(whole, "artist_id", "feature_name")
    slim, full = (etl.artists_etl(featured(spark), with_features=w) for w in (False, True))
    for made in (out, slim):
        assert not any(kind.startswith("array") for _, kind in made.dtypes)
    assert rows(slim) == [("1", "a", 3, 3, name) for name in ("X", "X", "Y Z")]
    assert rows(full.drop("features")) == rows(slim)
    assert {tuple(r.features) for r in full.collect()} == {("X", "X", "Y;Z")}


def test_self_join_gives_the_same_sets(spark):
    songs = featured(spark)
    kept = artists.drop_empty_features(songs).select("artist_id", "features")
    full = kept.join(songs.drop("features"), "artist_id").select("artist_id", "artist_name", "num_songs", "features").distinct()
    assert rows(full) == rows(artists.artist_feature_sets(songs))


def test_uuid_is_unique(spark):
    df = artists.generate_uuid(spark.range(1000))
    assert df.select("uuid").distinct().count() == 1000


def test_frame_size_counts_null_key(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (1, None)], "id long, x string")
    assert profile.frame_size(df).first()[:] == (3, 6, 2)


def test_profiles_agree(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "id long, x string")
    expected = [("id", "bigint", 0, 3), ("x", "string", 1, 1)]
    assert rows(profile.column_profile(df)) == expected
    assert rows(profile.column_profile(df, exact=True)) == expected


def test_step_counts_are_cumulative(spark):
    df = spark.range(10)
    got = profile.step_counts(df, {"all": F.lit(True), "big": F.col("id") > 4, "even": F.col("id") % 2 == 0})
    assert rows(got) == [("all", 10), ("big", 5), ("even", 2)]


def test_value_share_ignores_nulls(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "x string")
    assert rows(stats.value_share(df, "x").withColumn("percent", F.round("percent", 3))) == [("a", 2, 66.667), ("b", 1, 33.333)]


def test_best_model_ties_and_missing_grid(spark):
    df = spark.createDataFrame([(3, "a", 0.5), (2, "a", 0.5), (4, "b", 0.1)], "topics int, alpha string, coherence double")
    assert stats.select_best_model(df).first().topics == 2
    assert rows(stats.coherence_by_setting(df)) == [("a", 2, 0.5), ("a", 3, 0.5), ("b", 4, 0.1)]
    with pytest.raises(ValueError):
        stats.coherence_by_setting(None)
