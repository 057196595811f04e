"""Sources, profiling, filters, columns, joins, aggregations, samples and rankings."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from registry.base import (
    SQL_DECADE,
    cte,
    decade_songs,
    query,
    songs,
    sql_clean,
    with_ctes,
)
from versemill.functions import text
from versemill.operators import artists, columns, profile, sampling, stats
from versemill.plans import corpus as corpus_plan
from versemill.plans import etl
from versemill.sources import batches as batch_source
from versemill.sources import logs
from versemill.sources import songs as song_source
from versemill.staging import new_path

SONGS = ", ".join(song_source.SONG_COLUMNS)


def songs_sql(body: str) -> str:
    return with_ctes(body, "songs")


# --- sources and sinks -----------------------------------------------------------------


@query("read_parquet", "SELECT * FROM documents")
def _(spark, sf):
    return song_source.read_parquet(spark, f"{sf}/documents.parquet")


@query("write_parquet", songs_sql("SELECT * FROM songs"))
def _(spark, sf):
    path = new_path(spark, "songs")
    song_source.write_parquet(songs(spark, sf), path, mode="overwrite")
    return song_source.read_parquet(spark, path)


_CSV_SQL = songs_sql("SELECT * REPLACE (CAST(views AS VARCHAR) AS views) FROM songs")


@query("read_songs_csv", _CSV_SQL)
def _(spark, sf):
    path = new_path(spark, "songs-csv")
    song_source.write_songs_csv(songs(spark, sf), path)
    return song_source.read_songs_csv(spark, path)


@query("write_songs_csv", songs_sql("SELECT id, year, views, length(lyrics) AS n_chars FROM songs"))
def _(spark, sf):
    path = new_path(spark, "songs-csv")
    song_source.write_songs_csv(songs(spark, sf), path)
    back = song_source.read_songs_csv(spark, path)
    return back.select("id", "year", F.col("views").cast("long").alias("views"), F.char_length("lyrics").cast("long").alias("n_chars"))


# about a quarter of the songs per batch, the last batch is shorter
cte(
    "batches",
    "SELECT *, CAST(floor((row_number() OVER (ORDER BY id) - 1)"
    " / (SELECT floor(count(*) / 4) + 1 FROM songs)) + 1 AS INTEGER) AS batch_id FROM songs",
    "songs",
)


def chunksize(df):
    return df.count() // 4 + 1


def written_batches(spark, sf):
    path = new_path(spark, "batches")
    df = songs(spark, sf)
    batch_source.write_batches(df, path, chunksize(df))
    return path


def batches(spark, sf):
    return batch_source.read_batches(spark, written_batches(spark, sf))


@query("split_batches", with_ctes("SELECT id, batch_id FROM batches", "batches"))
def _(spark, sf):
    df = songs(spark, sf)
    return batch_source.split_batches(df, chunksize(df)).select("id", "batch_id")


@query("load_batch", with_ctes(f"SELECT {SONGS}, batch_id FROM batches WHERE batch_id = 2", "batches"))
def _(spark, sf):
    df = songs(spark, sf)
    return batch_source.load_batch(spark, new_path(spark, "batches"), 2, source=df, chunksize=chunksize(df))


_DRAWN = ", ".join(str(i) for i in random.Random(42).sample([1, 2, 3, 4], 3))


@query("random_batches", with_ctes(f"SELECT id, batch_id FROM batches WHERE batch_id IN ({_DRAWN})", "batches"))
def _(spark, sf):
    return batch_source.random_batches(spark, written_batches(spark, sf), 3, 42).select("id", "batch_id")


@query("union_batches", with_ctes("SELECT id, batch_id FROM batches", "batches"))
def _(spark, sf):
    path = written_batches(spark, sf)
    parts = [batch_source.load_batch(spark, path, i) for i in batch_source.batch_ids(spark, path)]
    return batch_source.union_batches(*parts).select("id", "batch_id")


@query(
    "batch_row_counts",
    with_ctes("SELECT 'data ' || batch_id AS batch, count(*) AS n_rows FROM batches GROUP BY batch_id", "batches"),
)
def _(spark, sf):
    return profile.batch_row_counts(batches(spark, sf))


@query(
    "count_by_year",
    with_ctes(
        "SELECT batch_id, year, count(*) AS n FROM batches WHERE year BETWEEN 1970 AND 2010 GROUP BY ALL", "batches"
    ),
)
def _(spark, sf):
    return stats.count_by_year(batches(spark, sf), 1970, 2010)


@query("load_or_create_sample", songs_sql("SELECT id FROM songs WHERE left(md5('42:' || id), 8) < '0ccccccc'"))
def _(spark, sf):
    path = new_path(spark, "sample")

    def create():
        return sampling.sample_fraction_hash(songs(spark, sf), 0.05)

    sampling.load_or_create_sample(spark, path, create)
    return sampling.load_or_create_sample(spark, path, create).select("id")


# a log line per song: every third one is noise
_BOUND = "'-' || CAST(id % 17 AS STRING) || '.' || CAST(100 + id % 900 AS STRING)"
_PERPLEXITY = "CAST((id * 13) % 5000 AS STRING) || '.' || CAST(id % 10 AS STRING)"
_LOG_LINE = (
    f"CASE WHEN id % 3 = 0 THEN 'INFO : topic #' || CAST(id % 10 AS STRING) || ' (0.100): 0.021*word'"
    f" ELSE 'INFO : ' || {_BOUND} || ' per-word bound, ' || {_PERPLEXITY}"
    " || ' perplexity estimate based on a held-out corpus of ' || CAST(length(lyrics) AS STRING) || ' words' END"
)


@query(
    "training_log_metrics",
    songs_sql(
        f"SELECT row_number() OVER (ORDER BY id) AS seq, CAST({_BOUND} AS DOUBLE) AS bound,"
        f" CAST({_PERPLEXITY} AS DOUBLE) AS perplexity FROM songs WHERE id % 3 <> 0 AND lyrics IS NOT NULL"
    ),
)
def _(spark, sf):
    path = new_path(spark, "log")
    songs(spark, sf).orderBy("id").select(F.expr(_LOG_LINE).alias("value")).where("value IS NOT NULL").write.text(path)
    return logs.training_log_metrics(spark, path)


# --- profiling -------------------------------------------------------------------------


@query("head_rows", songs_sql("SELECT * FROM songs ORDER BY id LIMIT 5"))
def _(spark, sf):
    return profile.head_rows(songs(spark, sf), 5)


_TYPES = {"id": "bigint", "year": "bigint", "views": "bigint"}


@query(
    "column_profile",
    songs_sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", '{_TYPES.get(c, 'string')}' AS type, count(*) - count({c}) AS nulls,"
            f" count(DISTINCT {c}) AS distinct_values FROM songs"
            for c in song_source.SONG_COLUMNS
        )
    ),
)
def _(spark, sf):
    return profile.column_profile(songs(spark, sf), exact=True)


@query("frame_size", songs_sql("SELECT count(*) AS n_rows, count(*) * 9 AS n_cells, count(DISTINCT id) AS distinct_ids FROM songs"))
def _(spark, sf):
    return profile.frame_size(songs(spark, sf))


@query(
    "null_columns",
    songs_sql(
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM songs" for c in song_source.SONG_COLUMNS
        )
        + ") WHERE nulls > 0"
    ),
)
def _(spark, sf):
    return profile.null_columns(songs(spark, sf))


_ANY_NULL = " OR ".join(f"{c} IS NULL" for c in song_source.SONG_COLUMNS)


@query("rows_with_nulls", songs_sql(f"SELECT * FROM songs WHERE {_ANY_NULL}"))
def _(spark, sf):
    return profile.rows_with_nulls(songs(spark, sf))


@query("distinct_years", songs_sql("SELECT DISTINCT year FROM songs"))
def _(spark, sf):
    return profile.distinct_years(songs(spark, sf))


def _steps_sql(job: str, steps: dict[str, str]) -> str:
    passed, counts = [], []
    for step, condition in steps.items():
        passed.append(f"({condition})")
        counts.append(f"SELECT '{job}' AS job, '{step}' AS step, count(*) AS n_rows FROM songs WHERE {' AND '.join(passed)}")
    return " UNION ALL ".join(counts)


_ETL_STEPS = {
    "input": "true",
    "year": "year > 1960 AND year <= 2024",
    "genre": "tag <> 'misc'",
    "lyrics": "lyrics IS NOT NULL",
}
_CORPUS_STEPS = {
    "input": "true",
    "language": "language = 'en'",
    "genre": "tag = 'rap'",
    "year": "year BETWEEN 1960 AND 2024",
    "lyrics": "lyrics IS NOT NULL",
    "artist": "artist NOT LIKE 'Genius%'",
}


@query("step_counts", songs_sql(_steps_sql("songs", _ETL_STEPS) + " UNION ALL " + _steps_sql("corpus", _CORPUS_STEPS)))
def _(spark, sf):
    df = songs(spark, sf)
    jobs = {"songs": etl.prefilter_steps(), "corpus": corpus_plan.corpus_steps()}
    counts = [profile.step_counts(df, steps).select(F.lit(job).alias("job"), "*") for job, steps in jobs.items()]
    return batch_source.union_batches(*counts)


# --- projections, filters, columns -----------------------------------------------------


@query("select_song_columns", songs_sql(f"SELECT {SONGS} FROM songs"))
def _(spark, sf):
    return columns.select_song_columns(decade_songs(spark, sf))


@query(
    "filter_year_range",
    songs_sql(
        "SELECT 'default' AS rule, id, year FROM songs WHERE year > 1960 AND year <= 2024"
        " UNION ALL SELECT 'closed', id, year FROM songs WHERE year >= 1960 AND year <= 2024"
        " UNION ALL SELECT 'half open', id, year FROM songs WHERE year >= 1960 AND year < 2023"
    ),
)
def _(spark, sf):
    df = songs(spark, sf)
    rules = {
        "default": columns.filter_year_range(df),
        "closed": columns.filter_year_range(df, include_low=True),
        "half open": columns.filter_year_range(df, 1960, 2023, include_low=True, include_high=False),
    }
    out = [kept.select(F.lit(rule).alias("rule"), "id", "year") for rule, kept in rules.items()]
    return batch_source.union_batches(*out)


@query("filter_year_window", songs_sql("SELECT * FROM songs WHERE year BETWEEN 1980 AND 1989"))
def _(spark, sf):
    return columns.filter_year_window(songs(spark, sf), 1980, 1989)


@query(
    "filter_genre",
    songs_sql(
        "SELECT 'not misc' AS rule, id, tag FROM songs WHERE tag <> 'misc'"
        " UNION ALL SELECT 'rap', id, tag FROM songs WHERE tag = 'rap'"
    ),
)
def _(spark, sf):
    df = songs(spark, sf)
    kept = columns.filter_genre(df, drop="misc").select(F.lit("not misc").alias("rule"), "id", "tag")
    return kept.unionByName(columns.filter_genre(df, keep="rap").select(F.lit("rap").alias("rule"), "id", "tag"))


@query("filter_language", songs_sql("SELECT * FROM songs WHERE language = 'en'"))
def _(spark, sf):
    return columns.filter_language(songs(spark, sf))


@query(
    "drop_nulls",
    songs_sql(
        "SELECT 'lyrics, tag' AS subset, id FROM songs WHERE lyrics IS NOT NULL AND tag IS NOT NULL"
        f" UNION ALL SELECT 'any', id FROM songs WHERE NOT ({_ANY_NULL})"
    ),
)
def _(spark, sf):
    df = songs(spark, sf)
    some = columns.drop_nulls(df, ["lyrics", "tag"]).select(F.lit("lyrics, tag").alias("subset"), "id")
    return some.unionByName(columns.drop_nulls(df).select(F.lit("any").alias("subset"), "id"))


@query("drop_artist_prefix", songs_sql("SELECT * FROM songs WHERE NOT starts_with(artist, 'Genius')"))
def _(spark, sf):
    return columns.drop_artist_prefix(songs(spark, sf))


@query("filter_year_language", songs_sql("SELECT * FROM songs WHERE year IN (2015, 2000) AND language = 'en'"))
def _(spark, sf):
    df = songs(spark, sf)
    return columns.filter_year_language(df, 2015).unionByName(columns.filter_year_language(df, 2000))


@query(
    "filter_decades",
    with_ctes(
        "SELECT 'list' AS rule, id, decade FROM decade_songs WHERE decade IN (1960, 1970, 1980)"
        " UNION ALL SELECT 'one', id, decade FROM decade_songs WHERE decade = 1970",
        "decade_songs",
    ),
)
def _(spark, sf):
    df, decades = decade_songs(spark, sf), [1960, 1970, 1980]
    listed = columns.filter_decades(df, decades).select(F.lit("list").alias("rule"), "id", "decade")
    return listed.unionByName(columns.filter_decades(df, decades, 1970).select(F.lit("one").alias("rule"), "id", "decade"))


_FIRST_OUTLIER = "(SELECT min_by(artist, id) FROM songs WHERE year < 215)"


@query("filter_artist", songs_sql(f"SELECT * FROM songs WHERE year < 215 AND artist = {_FIRST_OUTLIER}"))
def _(spark, sf):
    df = songs(spark, sf)
    first = df.where("year < 215").agg(F.min_by("artist", "id")).first()[0]
    return columns.filter_artist(df, first)


@query(
    "filter_genre_decade",
    with_ctes("SELECT id, lyrics FROM decade_songs WHERE tag = 'rap' AND decade = 2010", "decade_songs"),
)
def _(spark, sf):
    return columns.filter_genre_decade(decade_songs(spark, sf), "rap", "2010")


@query(
    "rename_columns",
    songs_sql("SELECT id, title, artist AS artist_name, year, tag AS genre, language, views, features, lyrics FROM songs"),
)
def _(spark, sf):
    return columns.rename_columns(songs(spark, sf))


@query(
    "cast_views",
    songs_sql(
        "SELECT id, try_cast(CASE WHEN id % 4 = 0 THEN 'n/a' ELSE CAST(views AS VARCHAR) END AS INTEGER) AS views FROM songs"
    ),
)
def _(spark, sf):
    df = songs(spark, sf).select("id", F.expr("CASE WHEN id % 4 = 0 THEN 'n/a' ELSE CAST(views AS STRING) END AS views"))
    return columns.cast_views(df)


@query("add_decade", with_ctes("SELECT id, year, decade FROM decade_songs", "decade_songs"))
def _(spark, sf):
    return decade_songs(spark, sf).select("id", "year", "decade")


@query(
    "repair_two_digit_year",
    songs_sql(
        "SELECT id, year, CAST(CASE WHEN year > 100 AND year <= 2023 THEN year WHEN year BETWEEN 0 AND 23 THEN year + 2000"
        " WHEN year BETWEEN 24 AND 99 THEN year + 1900 END AS INTEGER) AS repaired FROM songs"
    ),
)
def _(spark, sf):
    return songs(spark, sf).select(
        "id", "year", columns.repair_two_digit_year(F.col("year"), strict=False).alias("repaired")
    )


@query("strip_dollar", songs_sql("SELECT id, replace(artist, '$', '') AS artist FROM songs"))
def _(spark, sf):
    return songs(spark, sf).select("id", columns.strip_dollar(F.col("artist")).alias("artist"))


_FEATURES = (
    r"string_split(replace(regexp_replace(regexp_replace(features, '^\{', ''), '\}$', ''), chr(34), ''), ',')"
)


@query(
    "clean_features",
    songs_sql(
        f"SELECT id, array_to_string({_FEATURES}, '|') AS features, CAST(len({_FEATURES}) AS BIGINT) AS n FROM songs"
    ),
)
def _(spark, sf):
    cleaned_features = songs(spark, sf).select("id", columns.clean_features(F.col("features")).alias("features"))
    return cleaned_features.select(
        "id", F.array_join("features", "|").alias("features"), F.size("features").cast("long").alias("n")
    )


@query("clean_text", songs_sql(f"SELECT id, {sql_clean('lyrics')} AS lyrics FROM songs"))
def _(spark, sf):
    return songs(spark, sf).select("id", text.clean_text(F.col("lyrics")).alias("lyrics"))


@query("clean_text_compact", songs_sql(f"SELECT id, {sql_clean('lyrics', '', False)} AS lyrics FROM songs"))
def _(spark, sf):
    return songs(spark, sf).select("id", text.clean_text_compact(F.col("lyrics")).alias("lyrics"))


@query(
    "strip_singles_and_symbols",
    songs_sql(
        "SELECT id, regexp_replace(array_to_string(list_filter("
        f"regexp_extract_all(lyrics, '[{text.WORD}]+|[^{text.WORD}]+'),"
        f" lambda r: NOT regexp_matches(r, '^[{text.WORD}]$')), ''), '[^{text.WORD}{text.SPACE}]', '', 'g') AS lyrics FROM songs"
    ),
)
def _(spark, sf):
    return songs(spark, sf).select("id", text.strip_singles_and_symbols(F.col("lyrics")).alias("lyrics"))


@query("replace_column", songs_sql(f"SELECT id, coalesce({sql_clean('lyrics')}, lyrics) AS lyrics FROM songs"))
def _(spark, sf):
    return columns.replace_column(songs(spark, sf), "lyrics", text.clean_text(F.col("lyrics"))).select("id", "lyrics")


# --- arrays, joins, the two jobs -------------------------------------------------------

cte(
    "prefiltered",
    f"SELECT id, title, artist AS artist_name, CAST(year AS BIGINT) AS year, tag AS genre, language,"
    f" CAST(views AS INTEGER) AS views, {_FEATURES} AS features, lyrics, {SQL_DECADE} AS decade, md5(artist) AS artist_id"
    " FROM songs WHERE year > 1960 AND year <= 2024 AND tag <> 'misc' AND lyrics IS NOT NULL",
    "songs",
)
cte(
    "trusted",
    "SELECT p.*, n.num_songs FROM prefiltered p JOIN (SELECT artist_id, artist_name, count(*) AS num_songs"
    " FROM prefiltered GROUP BY artist_id, artist_name HAVING count(*) >= 15) n USING (artist_id, artist_name)",
    "prefiltered",
)
cte(
    "feature_rows",
    "SELECT * FROM trusted WHERE features IS NOT NULL AND NOT list_contains(features, '')",
    "trusted",
)
cte(
    "feature_arrays",
    "SELECT artist_id, artist_name, num_songs, flatten(list_sort(list(features))) AS features FROM"
    " (SELECT DISTINCT artist_id, artist_name, num_songs, features FROM feature_rows) GROUP BY artist_id, artist_name, num_songs",
    "feature_rows",
)
cte(
    "exploded_features",
    "SELECT *, unnest(features) AS feature_name FROM feature_arrays",
    "feature_arrays",
)


def trusted(spark, sf):
    return etl.songs_etl(songs(spark, sf))


def _flat(df):
    return df.withColumn("features", F.array_join("features", "|"))


@query("drop_empty_features", with_ctes("SELECT id, array_to_string(features, '|') AS features FROM feature_rows", "feature_rows"))
def _(spark, sf):
    return _flat(artists.drop_empty_features(trusted(spark, sf)).select("id", "features"))


_ARTIST = "artist_id, artist_name, num_songs, array_to_string(features, '|') AS features, CAST(len(features) AS INTEGER) AS num_features"


@query("artist_features", with_ctes(f"SELECT {_ARTIST} FROM feature_arrays", "feature_arrays"))
def _(spark, sf):
    return _flat(artists.artist_features(trusted(spark, sf)))


@query(
    "artist_feature_join",
    with_ctes(
        "SELECT DISTINCT f.artist_id, f.artist_name, f.num_songs, array_to_string(f.features, '|') AS features"
        " FROM feature_rows f JOIN trusted t USING (artist_id)",
        "feature_rows",
    ),
)
def _(spark, sf):
    return _flat(artists.artist_feature_sets(trusted(spark, sf)))


@query("explode_features", with_ctes("SELECT artist_id, feature_name FROM exploded_features", "exploded_features"))
def _(spark, sf):
    return artists.explode_features(artists.artist_feature_sets(trusted(spark, sf))).select("artist_id", "feature_name")


@query(
    "feature_display_name",
    with_ctes("SELECT artist_id, replace(feature_name, ';', ' ') AS feature_name FROM exploded_features", "exploded_features"),
)
def _(spark, sf):
    rows = artists.explode_features(artists.artist_feature_sets(trusted(spark, sf)))
    return artists.feature_display_name(rows).select("artist_id", "feature_name")


@query("add_artist_id", songs_sql("SELECT id, artist AS artist_name, md5(artist) AS artist_id FROM songs WHERE artist IS NOT NULL"))
def _(spark, sf):
    return artists.add_artist_id(columns.rename_columns(songs(spark, sf))).select("id", "artist_name", "artist_id")


@query("artists_dim", songs_sql("SELECT DISTINCT md5(artist) AS artist_id, artist AS artist_name FROM songs WHERE artist IS NOT NULL"))
def _(spark, sf):
    return artists.artists_dim(columns.rename_columns(songs(spark, sf)))


@query(
    "songs_per_artist",
    songs_sql("SELECT md5(artist) AS artist_id, artist AS artist_name, count(*) AS num_songs FROM songs GROUP BY artist"),
)
def _(spark, sf):
    return artists.songs_per_artist(artists.add_artist_id(columns.rename_columns(songs(spark, sf))))


@query(
    "keep_prolific_artists",
    songs_sql(
        "SELECT id, artist AS artist_name, count(*) OVER (PARTITION BY artist) AS num_songs FROM songs"
        " WHERE artist IS NOT NULL QUALIFY num_songs >= 15"
    ),
)
def _(spark, sf):
    named = artists.add_artist_id(columns.rename_columns(songs(spark, sf)))
    return artists.keep_prolific_artists(named).select("id", "artist_name", "num_songs")


@query(
    "songs_etl",
    with_ctes("SELECT * REPLACE (array_to_string(features, '|') AS features) FROM trusted", "trusted"),
)
def _(spark, sf):
    return _flat(trusted(spark, sf))


@query(
    "artists_etl",
    with_ctes(f"SELECT {_ARTIST}, replace(feature_name, ';', ' ') AS feature_name FROM exploded_features", "exploded_features"),
)
def _(spark, sf):
    return _flat(etl.artists_etl(trusted(spark, sf)))


@query("generate_uuid")
def _(spark, sf):
    return artists.generate_uuid(songs(spark, sf)).select("id", "uuid")


# --- aggregations ----------------------------------------------------------------------


def decade_sql(body: str) -> str:
    return with_ctes(body, "decade_songs")


@query("count_by_decade", decade_sql("SELECT decade, count(*) AS n FROM decade_songs GROUP BY decade"))
def _(spark, sf):
    return stats.count_by_decade(decade_songs(spark, sf))


@query("count_by_decade_genre", decade_sql("SELECT decade, tag, count(*) AS n FROM decade_songs GROUP BY ALL"))
def _(spark, sf):
    return stats.count_by_decade_genre(decade_songs(spark, sf))


@query(
    "genre_share_by_decade",
    decade_sql(
        "SELECT decade, tag, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY decade), 6) AS share"
        " FROM decade_songs GROUP BY decade, tag"
    ),
)
def _(spark, sf):
    return stats.genre_share_by_decade(decade_songs(spark, sf)).withColumn("share", F.round("share", 6))


@query("outlier_genre_counts", songs_sql("SELECT tag, count(*) AS n FROM songs WHERE year < 215 GROUP BY tag"))
def _(spark, sf):
    return stats.outlier_genre_counts(songs(spark, sf))


@query(
    "count_by_genre",
    songs_sql("SELECT tag, count(*) AS n FROM songs WHERE year = 2015 AND language = 'en' GROUP BY tag"),
)
def _(spark, sf):
    return stats.count_by_genre(columns.filter_year_language(songs(spark, sf), 2015))


@query(
    "genre_views",
    songs_sql(
        "SELECT year, tag, count(*) AS n, CAST(sum(views) AS BIGINT) AS total_views FROM songs"
        " WHERE year IN (2015, 2000) AND language = 'en' GROUP BY year, tag"
    ),
)
def _(spark, sf):
    df = songs(spark, sf)
    parts = [
        stats.genre_views(columns.filter_year_language(df, y)).select(
            F.lit(y).cast("long").alias("year"), "tag", "n", "total_views"
        )
        for y in (2015, 2000)
    ]
    return batch_source.union_batches(*parts)


@query(
    "value_share",
    songs_sql(
        "SELECT replace(artist, '$', '') AS value, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent"
        " FROM songs WHERE artist IS NOT NULL GROUP BY 1"
    ),
)
def _(spark, sf):
    shares = stats.value_share(songs(spark, sf), columns.strip_dollar(F.col("artist")))
    return shares.withColumn("percent", F.round("percent", 6))


def _representativeness_sql(name: str, value: str) -> str:
    def side(share: str, where: str) -> str:
        return (
            f"(SELECT CAST({value} AS VARCHAR) AS value, count(*) * 100.0 / sum(count(*)) OVER () AS {share}"
            f" FROM corpus {where} GROUP BY 1)"
        )

    sampled = "WHERE left(md5('42:' || id), 8) < '33333333'"
    return (
        f"SELECT '{name}' AS attribute, value, round(coalesce(total_percent, 0), 6) AS total_percent,"
        " round(coalesce(sample_percent, 0), 6) AS sample_percent,"
        " round(coalesce(sample_percent, 0) - coalesce(total_percent, 0), 6) AS difference"
        f" FROM {side('total_percent', '')} a FULL JOIN {side('sample_percent', sampled)} b USING (value)"
    )


@query(
    "sample_representativeness",
    with_ctes(
        _representativeness_sql("artist", "replace(artist, '$', '')")
        + " UNION ALL "
        + _representativeness_sql("decade", "decade"),
        "corpus",
    ),
)
def _(spark, sf):
    full = corpus_plan.filter_corpus(songs(spark, sf))
    sample = sampling.sample_fraction_hash(full, 0.2)
    by_artist = stats.sample_representativeness(full, sample, columns.strip_dollar(F.col("artist")))
    by_decade = stats.sample_representativeness(full, sample, F.col("decade").cast("string"))
    both = by_artist.select(F.lit("artist").alias("attribute"), "*").unionByName(
        by_decade.select(F.lit("decade").alias("attribute"), "*")
    )
    return both.select(
        "attribute", "value", *[F.round(c, 6).alias(c) for c in ("total_percent", "sample_percent", "difference")]
    )


# --- samples ---------------------------------------------------------------------------


@query("sample_fraction")
def _(spark, sf):
    return sampling.sample_fraction(songs(spark, sf)).select("id", "artist", "year")


@query("sample_fraction_hash", songs_sql("SELECT * FROM songs WHERE left(md5('42:' || id), 8) < '0ccccccc'"))
def _(spark, sf):
    return sampling.sample_fraction_hash(songs(spark, sf), 0.05, 42)


@query(
    "sample_balanced",
    decade_sql(
        "SELECT id, decade FROM decade_songs WHERE year > 215"
        " QUALIFY row_number() OVER (PARTITION BY decade ORDER BY md5('20:' || id))"
        " <= (SELECT floor(0.2 * min(n)) FROM (SELECT count(*) AS n FROM decade_songs WHERE year > 215 GROUP BY decade))"
    ),
)
def _(spark, sf):
    plausible = decade_songs(spark, sf).where("year > 215")
    return sampling.sample_balanced(plausible).select("id", "decade")


@query(
    "group_frequency_weights",
    decade_sql(
        "SELECT id, decade, n AS group_count, round(0.3 * (SELECT count(*) FROM songs)"
        " / ((SELECT count(DISTINCT n) FROM (SELECT count(*) AS n FROM decade_songs GROUP BY decade)) * n), 6) AS freq"
        " FROM (SELECT id, decade, count(*) OVER (PARTITION BY decade) AS n FROM decade_songs)"
    ),
)
def _(spark, sf):
    weighted = sampling.group_frequency_weights(decade_songs(spark, sf))
    return weighted.select("id", "decade", "group_count", F.round("freq", 6).alias("freq"))


# --- windows, rankings -----------------------------------------------------------------


@query(
    "group_count_per_row",
    decade_sql("SELECT id, decade, count(*) OVER (PARTITION BY decade) AS group_count FROM decade_songs"),
)
def _(spark, sf):
    return stats.group_count_per_row(decade_songs(spark, sf)).select("id", "decade", "group_count")


@query("top_viewed", songs_sql("SELECT * FROM songs WHERE year < 215 ORDER BY views DESC, id LIMIT 20"))
def _(spark, sf):
    return stats.top_viewed(songs(spark, sf).where("year < 215"))


@query("first_by_year", songs_sql("SELECT * FROM songs ORDER BY year, id LIMIT 20"))
def _(spark, sf):
    return stats.first_by_year(songs(spark, sf))


# grid results: mean text lengths stand in for coherence values
_GRID = (
    "CAST(2 + id % 9 AS INTEGER) AS topics",
    "CASE WHEN tag = 'rap' THEN 'asymmetric' ELSE 'symmetric' END AS alpha",
    "CASE WHEN language = 'en' THEN 'symmetric' ELSE 'auto' END AS eta",
)
cte(
    "grid",
    f"SELECT topics, alpha, eta, round(avg(length(lyrics)), 6) AS coherence FROM (SELECT {', '.join(_GRID)}, lyrics FROM songs)"
    " GROUP BY topics, alpha, eta",
    "songs",
)


def grid_results(spark, sf):
    return (
        songs(spark, sf)
        .select(*[F.expr(e) for e in _GRID], F.char_length("lyrics").alias("n"))
        .groupBy("topics", "alpha", "eta")
        .agg(F.round(F.avg("n"), 6).alias("coherence"))
    )


@query(
    "select_best_model",
    with_ctes("SELECT * FROM grid ORDER BY coherence DESC, topics, alpha, eta LIMIT 1", "grid"),
)
def _(spark, sf):
    return stats.select_best_model(grid_results(spark, sf), ("topics", "alpha", "eta"))


@query(
    "coherence_by_setting",
    with_ctes("SELECT alpha, topics, round(avg(coherence), 4) AS coherence FROM grid GROUP BY alpha, topics", "grid"),
)
def _(spark, sf):
    return stats.coherence_by_setting(grid_results(spark, sf), "alpha").withColumn("coherence", F.round("coherence", 4))


# --- the prepared corpus ---------------------------------------------------------------


@query(
    "prepare_corpus",
    with_ctes(
        f"SELECT * REPLACE (replace(artist, '$', '') AS artist, {sql_clean('lyrics')} AS lyrics) FROM corpus"
        " WHERE left(md5('42:' || id), 8) < '33333333'",
        "corpus",
    ),
)
def _(spark, sf):
    return corpus_plan.prepare_corpus(songs(spark, sf), 0.2)


