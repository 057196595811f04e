"""The operators as queries over the driver tables, next to the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versemill.llm import (
    decontamination,
    exact_dedup,
    language,
    merkle,
    minhash,
    ngram_join,
    packing,
    pii,
    quality,
    runs,
    sharding,
    suffix_dedup,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- exact duplicates ------------------------------------------------------------------


@query(
    "op3_exact_dedup",
    r"""
WITH hashed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM hashed WINDOW same AS (PARTITION BY text_sha256)""",
)
def op3_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf, "documents"), digests=True).drop("row")


# --- near-duplicates -------------------------------------------------------------------

_NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
sets AS (SELECT doc_id, list(hash(s) ORDER BY s) AS k FROM shingles GROUP BY doc_id),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS c FROM sets),
firsts AS (SELECT s.doc_id, s.s FROM shingles s JOIN classes c ON s.doc_id = c.doc_id AND c.doc_id = c.c),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM firsts a JOIN firsts b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 80 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT DISTINCT c AS node, c AS other FROM classes
  UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
components AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
  d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN classes c ON c.doc_id = d.doc_id
LEFT JOIN components ON node = c.c"""


@query("op7_minhash", _NEAR_SQL)
def op7_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"), words=4).drop("row")


# --- packing ---------------------------------------------------------------------------


@query("op5_packing")
def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


# --- toxicity --------------------------------------------------------------------------


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.train_toxicity(docs, table(spark, sf, "labels"))
    scored = toxicity.score_toxicity(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        F.size("toxic_spans").alias("n_spans"),
    )


# --- benchmark decontamination ---------------------------------------------------------


@query("op9_decontamination")
def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.find_contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


# --- quality ---------------------------------------------------------------------------


@query("op1_quality")
def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.train_quality(docs, table(spark, sf, "labels"))
    return quality.score_quality(docs, model, keep=["doc_id"]).select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality").alias("score"),
        (F.col("quality") >= 0.3).cast("int").alias("predicted"),
    )


# --- language --------------------------------------------------------------------------


@query("op8_language")
def op8_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    profiles = language.learn_profiles(docs)
    return language.identify_language(docs.select("doc_id", "text"), profiles, keep=["doc_id"]).select(
        "doc_id",
        language.held_out(F.col("doc_id")).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )


# --- sharding --------------------------------------------------------------------------


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf, "documents"), shards=40)


# --- personal data ---------------------------------------------------------------------


@query("op4_pii")
def op4_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf, "documents")))


# --- repeated passages -----------------------------------------------------------------

_REPEATS_SQL = """
WITH texts AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM texts WHERE n >= 50)),
firsts AS (SELECT s, min(doc_id) AS f FROM windows GROUP BY s),
repeats AS (SELECT doc_id, p FROM windows JOIN firsts USING (s) WHERE f < doc_id),
places AS (
  SELECT doc_id, substr(h, 2 * i + 1, 2) AS c, i FROM (SELECT doc_id, h, unnest(range(0, n)) AS i FROM texts)),
marked AS (
  SELECT b.doc_id, i, c, count(r.p) OVER (PARTITION BY b.doc_id ORDER BY i ROWS 49 PRECEDING) > 0 AS gone
  FROM places b LEFT JOIN repeats r ON r.doc_id = b.doc_id AND r.p = b.i),
edged AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM marked),
kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans,
    string_agg(c, '' ORDER BY i) FILTER (NOT gone) AS h FROM edged GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k.h, ''))) AS kept_sha256
FROM texts LEFT JOIN kept k USING (doc_id)"""


@query("op2_suffix_dedup", _REPEATS_SQL)
def op2_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf, "documents"))


# --- manifest --------------------------------------------------------------------------


def _manifest_sql(levels: int = 6) -> str:
    """The trees level by level; 16 ** levels rows of a source, and sources, have room."""
    value = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
    fields = [value.format(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # crc32 bit by bit: -1 shifts, other numbers are bytes
    crc = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
      string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END))"""
    leaf, altered = (f"sha256({' || '.join([*fields, value.format(t)])})" for t in ("text", lowered))
    parts = [
        f"""WITH leaves AS (
  SELECT doc_id, source, {leaf} AS h, CASE WHEN {crc} % 5 = 0 THEN {altered} ELSE {leaf} END AS changed,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS r
  FROM documents),
s0 AS (SELECT source AS tree, r AS i, h FROM leaves)"""
    ]

    def grow(name: str) -> None:
        for level in range(levels):
            here, after = f"{name}{level}", f"{name}{level + 1}"
            parts.append(f"""{here}x AS (
  SELECT tree, i, h, count(*) OVER (PARTITION BY tree) > 1 AS many,
    coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {here} WINDOW run AS (PARTITION BY tree, i // 16 ORDER BY i))""")
            parts.append(f"""{after} AS (
  SELECT tree, i // 16 AS i, CASE WHEN bool_or(many) THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h
  FROM {here}x GROUP BY tree, i // 16)""")

    grow("s")
    parts.append(f"""roots AS (
  SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place FROM s{levels}),
t0 AS (SELECT 0 AS tree, place AS i, subroot AS h FROM roots)""")
    grow("t")
    joins = []
    for name, place in (("s", "v.r"), ("t", "place")):
        for level in range(levels):
            node = f"{name}{level}x"
            tree = f"{node}.tree IS NOT DISTINCT FROM v.source" if name == "s" else f"{node}.tree = 0"
            joins.append(f"JOIN {node} ON {tree} AND {node}.i = {place} // {16**level}")
    parts.append("""paths AS (
  SELECT doc_id, v.h AS leaf, subroot, t%d.h AS root, changed, %s
  FROM leaves v JOIN roots ON roots.tree IS NOT DISTINCT FROM v.source CROSS JOIN t%d %s)""" % (
        levels,
        ", ".join(f"{n}{k}x.l AS {n}l{k}, {n}{k}x.r AS {n}r{k}, {n}{k}x.many AS {n}m{k}" for n in "st" for k in range(levels)),
        levels,
        " ".join(joins),
    ))
    last = "paths"
    for number, (n, k) in enumerate((n, k) for n in "st" for k in range(levels)):
        parts.append(
            f"f{number} AS (SELECT * REPLACE (CASE WHEN {n}m{k} THEN sha256({n}l{k} || changed || {n}r{k}) "
            f"ELSE changed END AS changed) FROM {last})"
        )
        last = f"f{number}"
    proof = " || ".join(f"{n}l{k} || {n}r{k}" for n in "st" for k in range(levels))
    return ",\n".join(parts) + (
        f"\nSELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, changed AS folded_root, "
        f"changed = root AS verified FROM {last}"
    )


@query("op12_merkle_manifest", _manifest_sql())
def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.verify_tampered(table(spark, sf, "documents"))


# --- periodic runs ---------------------------------------------------------------------


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf, "documents"), probe=True)


# --- similar texts ---------------------------------------------------------------------

_JOIN_SQL = (
    _NEAR_SQL.replace("w[i:i + 3]", "w[i:i + 2]")
    .replace("len(w) - 3", "len(w) - 2")
    .replace("80 * (x.n", "90 * (x.n")
    .replace(",\n  d.doc_id = coalesce(component_id, d.doc_id) AS kept", "")
)


@query("op11_ngram_join", _JOIN_SQL)
def op11_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.similar_texts(table(spark, sf, "documents")).drop("row")
