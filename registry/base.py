"""Registration of queries with their SQL, and the inputs they share.

The driver tables hold no songs, so a song table is derived from ``documents``: the same
expressions run in Spark and in the checking engine. All rows and whole texts are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versemill.functions import text, words
from versemill.sources.songs import read_spread
from versemill.staging import stage

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where there is one, the SQL with the same result."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def cte(name: str, body: str, *needs: str) -> None:
    """Define a named subquery for :func:`with_ctes`."""
    _CTES[name] = (body, needs)


def with_ctes(body: str, *needs: str) -> str:
    """``body`` preceded by the subqueries it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for need in _CTES[name][1]:
                add(need)
            order.append(name)

    for need in needs:
        add(need)
    return "WITH " + ",\n".join(f"{n} AS ({_CTES[n][0]})" for n in order) + "\n" + body


# --- the song table -------------------------------------------------------------------

SONG_EXPRESSIONS = (
    "doc_id AS id",
    "CASE WHEN doc_id % 37 = 0 THEN NULL ELSE 'Song ' || CAST(doc_id AS STRING) END AS title",
    "CASE WHEN doc_id % 29 = 0 THEN 'Genius ' || source"
    " WHEN doc_id % 5 = 0 THEN 'A$' || source ELSE source END AS artist",
    "CASE WHEN doc_id % 41 = 0 THEN doc_id % 100 ELSE 1955 + (doc_id * 7) % 71 END AS year",
    "CASE WHEN doc_id % 6 IN (0,1) THEN 'rap' WHEN doc_id % 6 = 2 THEN 'pop'"
    " WHEN doc_id % 6 = 3 THEN 'rock' WHEN doc_id % 6 = 4 THEN 'rb' ELSE 'misc' END AS tag",
    "lang AS language",
    "(doc_id * 7919) % 100003 AS views",
    "CASE WHEN doc_id % 4 = 0 THEN '{}'"
    " WHEN doc_id % 4 = 1 THEN '{\"Feat ' || CAST(doc_id % 7 AS STRING) || '\"}'"
    " WHEN doc_id % 4 = 2 THEN '{\"Feat ' || CAST(doc_id % 7 AS STRING) || '\",\"DJ;' || CAST(doc_id % 5 AS STRING) || '\"}'"
    " ELSE '{Feat ' || CAST(doc_id % 3 AS STRING) || '}' END AS features",
    "CASE WHEN doc_id % 53 = 0 THEN NULL"
    " ELSE '[Verse ' || CAST(doc_id % 3 AS STRING) || '] ' || text END AS lyrics",
)


def songs(spark: SparkSession, sf: str) -> DataFrame:
    return read_spread(spark, f"{sf}/documents.parquet").selectExpr(*SONG_EXPRESSIONS)


def decade_songs(spark: SparkSession, sf: str) -> DataFrame:
    from versemill.operators.columns import add_decade

    return add_decade(songs(spark, sf))


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """All songs with lyrics, cleaned."""
    return (
        decade_songs(spark, sf)
        .where(F.col("lyrics").isNotNull())
        .withColumn("lyrics", text.clean_text(F.col("lyrics")))
    )


def tokenized(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, decade, tag, tokens)`` of all songs with lyrics, split at white space."""
    return cleaned(spark, sf).select("id", "decade", "tag", text.tokenize_whitespace(F.col("lyrics")).alias("tokens"))


def staged_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The same, written once for queries that read the tokens several times."""
    return stage(tokenized(spark, sf), "tokens")


def content_words(spark: SparkSession, sf: str) -> DataFrame:
    """All songs as token lists without stop words and words of one or two characters."""
    tokens = text.remove_stop_words(text.filter_token_length(F.col("tokens")), words.ENGLISH)
    return tokenized(spark, sf).withColumn("tokens", tokens)


def joined(df: DataFrame, column: str = "tokens") -> DataFrame:
    """``(id, tokens, n_tokens)`` with the tokens as one string, for comparison."""
    return df.select(
        "id",
        F.array_join(column, " ").alias("tokens"),
        F.size(column).cast("long").alias("n_tokens"),
    )


# --- SQL fragments ---------------------------------------------------------------------

WORD, SPACE, SEPARATOR = text.WORD, text.SPACE, text.SEPARATOR


def sql_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def sql_clean(x: str, newline: str = " ", parentheses: bool = True) -> str:
    out = f"replace({x}, chr(10), '{newline}')"
    out = f"regexp_replace({out}, '[,.!?]', '', 'g')"
    out = rf"regexp_replace({out}, '\[.*?\]', ' ', 'g')"
    out = rf"regexp_replace({out}, '[{WORD}]*\p{{Nd}}[{WORD}]*', ' ', 'g')"
    if parentheses:
        out = f"regexp_replace({out}, '[()]', ' ', 'g')"
    return f"lower({out})"


def sql_ws(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{SPACE}]+'), lambda t: t <> '')"


def sql_words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[{WORD}]+')"


def sql_long_tokens(x: str, numeric: bool = True) -> str:
    test = r" AND NOT regexp_matches(t, '^\p{N}+$')" if numeric else ""
    return f"list_filter({x}, lambda t: length(t) > 2{test})"


def sql_stop(x: str, listed) -> str:
    return f"list_filter({x}, lambda t: t NOT IN {sql_list(listed)})"


def sql_lemma(t: str) -> str:
    return f"CASE WHEN length({t}) > 3 AND {t} LIKE '%s' AND {t} NOT LIKE '%ss' THEN left({t}, length({t}) - 1) ELSE {t} END"


def sql_tag(t: str) -> str:
    return (
        f"CASE WHEN {t} LIKE '%ing' THEN 'VBG' WHEN {t} LIKE '%ed' THEN 'VBD' WHEN {t} LIKE '%ly' THEN 'RB'"
        f" WHEN {t} LIKE '%er' THEN 'JJ' ELSE 'NN' END"
    )


SQL_JOINED = "id, array_to_string(tokens, ' ') AS tokens, CAST(len(tokens) AS BIGINT) AS n_tokens"
SQL_DECADE = "CAST(floor(year / 10.0) * 10 AS INTEGER)"

cte("songs", "SELECT " + ", ".join(SONG_EXPRESSIONS) + " FROM documents")
cte("decade_songs", f"SELECT *, {SQL_DECADE} AS decade FROM songs", "songs")
cte(
    "cleaned",
    f"SELECT id, title, artist, year, tag, language, views, features, decade, {sql_clean('lyrics')} AS lyrics"
    " FROM decade_songs WHERE lyrics IS NOT NULL",
    "decade_songs",
)
cte("tokenized", f"SELECT id, decade, tag, {sql_ws('lyrics')} AS tokens FROM cleaned", "cleaned")
cte(
    "content",
    f"SELECT id, decade, tag, {sql_stop(sql_long_tokens('tokens'), words.ENGLISH)} AS tokens FROM tokenized",
    "tokenized",
)
cte(
    "corpus",
    f"SELECT *, {SQL_DECADE} AS decade FROM songs WHERE language = 'en' AND tag = 'rap'"
    " AND year BETWEEN 1960 AND 2024 AND lyrics IS NOT NULL AND artist NOT LIKE 'Genius%'",
    "songs",
)
