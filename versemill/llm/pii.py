"""Personal data by patterns, and terms that disclose it by how they occur with it in the corpus.

Everything here is DataFrame expressions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.joins import fits_in_memory, join_lookup
from versemill.staging import stage

KINDS = ("email", "ip", "card", "phone")

# A run of the characters that a match begins with is entered at its start only, or where
# the match before it ended; runs are possessive. This changes no match, but a long run
# costs one attempt instead of one per character, and no repetition is kept on a stack.
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

# Texts without these characters have no match.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

# Share of the entity's information that a term must give away, and the texts that the
# estimate from the part of the entity counts as beside the texts that hold the term.
DISCLOSURE, SMOOTHING = 0.9, 0.5

# Letters of scripts without spaces, where each pair of neighbours is a word.
_SPACELESS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_WORD, _PAIR = rf"([\p{{L}}&&[^{_SPACELESS}]]+)", rf"(?=([{_SPACELESS}]{{2}}))"
_LETTER = rf"[\p{{L}}&&[^{_SPACELESS}]]"
_LEFT, _RIGHT = rf"(?<!{_LETTER})(?:", rf")(?!{_LETTER})"
_MARK, _OTHER = "\x01", "\x02"


def _matches(text: Column, pattern: str | Column) -> Column:
    """``array<struct<start, end, value>>`` of all matches, in code points."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    safe = F.translate(text, _MARK, _OTHER)
    parts = F.split(F.regexp_replace(safe, pattern, F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("at"), none.alias("found"))

    def step(state: Column, part: Column) -> Column:
        end = state["at"] + F.char_length(part)
        span = F.struct(state["at"].alias("start"), end.alias("end"), part.alias("value"))
        return F.struct(
            (~state["inside"]).alias("inside"),
            end.alias("at"),
            F.when(state["inside"], F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"),
        )

    return F.aggregate(parts, start, step, lambda state: state["found"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _passes_luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.ascii(F.substring(digits, n - i, F.lit(1))) - F.lit(48)
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return (total + F.when(i % 2 == 1, twice).otherwise(digit)).cast("int")

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    digits = _digits(value)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _passes_luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15)


def base_spans(kind: str, text: Column) -> Column:
    """Spans of one kind: leftmost non-overlapping matches, without those that fail their test."""
    needs = F.contains(text, F.lit(_NEEDS[kind])) if _NEEDS[kind] else text.rlike("[0-9]")
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(
        needs, F.filter(_matches(text, _PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
    ).otherwise(none)


def _with_base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text`` with ``key1, key2`` of the text and an array of spans per kind."""
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")
    )
    return rows.select(
        "*",
        F.xxhash64("text").alias("key1"),
        F.hash("text").alias("key2"),
        *(base_spans(k, F.col("text")).alias(k) for k in KINDS),
    )


def _entity(kind: str, value: Column) -> Column:
    """One name for the spellings of an entity."""
    return F.lower(value) if kind == "email" else value if kind == "ip" else _digits(value)


def _part(kind: str, value: Column) -> Column:
    """What an entity shares with others of its kind: domain, network, issuer or area."""
    entity = _entity(kind, value)
    if kind == "email":
        return F.substring_index(entity, "@", -1)
    if kind == "ip":
        return F.substring_index(entity, ".", 2)
    length = F.lit(6) if kind == "card" else F.greatest(F.length(entity) - 7, F.lit(1))
    return F.substring(entity, F.lit(1), length)


def _entities(kind: str) -> Column:
    """Per span of a kind its entity and the part of that."""

    def one(span: Column) -> Column:
        entity = F.xxhash64(F.lit(kind), _entity(kind, span["value"]))
        part = F.xxhash64(F.lit(kind), F.lit("part"), _part(kind, span["value"]))
        return F.struct(F.lit(kind).alias("kind"), part.alias("part"), entity.alias("entity"))

    return F.transform(kind, one)


def _words(text: Column) -> Column:
    """The words of a text in lower case, each once; those within e-mail addresses do not count."""
    free = F.lower(F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, _PATTERNS["email"], "\n")).otherwise(text))
    pairs = F.when(F.octet_length(free) > F.char_length(free), F.regexp_extract_all(free, F.lit(_PAIR), 1))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.regexp_extract_all(free, F.lit(_WORD), 1), F.coalesce(pairs, none)))


def _small(df: DataFrame) -> DataFrame:
    """The written table, broadcast if it is measured to be small."""
    return F.broadcast(df) if fits_in_memory(df) else df


def _units(entities: DataFrame) -> DataFrame:
    """``(key1, key2, unit, part, kind, n_entity, n_part, n_kind)`` of the entities of all texts.

    Entities of one part that occur in the same texts have the same counts with every term
    and are one unit, so a text that lists many entities does not pair each with each word.
    """
    counted = entities.groupBy("entity").agg(
        F.count("*").alias("n_entity"), F.bit_xor(F.xxhash64("key1", "key2")).alias("where")
    )
    rows = join_lookup(entities, counted, ["entity"], ["key1", "key2"])
    for name in ("part", "kind"):
        n = entities.select("key1", "key2", name).distinct().groupBy(name).agg(F.count("*").alias(f"n_{name}"))
        rows = join_lookup(rows, n, [name], ["key1", "key2", "entity"])
    unit = F.xxhash64("part", "where", "n_entity").alias("unit")
    return rows.select("key1", "key2", unit, "part", "kind", "n_entity", "n_part", "n_kind").distinct()


def disclosing_terms(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    disclosure: float = DISCLOSURE,
    smoothing: float = SMOOTHING,
) -> DataFrame:
    """``(key1, key2, terms)``: per text the terms that disclose an entity.

    A term is a word of any length, in lower case; in scripts without spaces it is a pair of
    neighbouring letters. Over all different texts, its pointwise mutual information with an
    entity of the same text, at any distance, is compared with the information of the entity
    itself, ``-log p(entity)``; a term that gives away at least the share ``disclosure`` is
    listed for each text that holds it, with or without the entity. Copies count once.

    ``p(entity | term)`` is smoothed, since most entities occur in one text: ``smoothing``
    texts are added that hold the entity as often as the part of it (domain, network,
    issuer, area) lets expect, whose share given the term is smoothed by that of the kind,
    and this by the share of the kind in all texts.
    """
    rows = _with_base(docs, id_col, text_col)
    words = rows.select("key1", "key2", F.explode(_words(F.col("text"))).alias("term"))
    texts = stage(
        rows.select("key1", "key2", F.concat(*map(_entities, KINDS)).alias("entities"), _words(F.col("text")).alias("words"))
        .where(F.size("entities") > 0),
        "pii-texts",
    )
    copies = stage(rows.groupBy("key1", "key2").agg(F.count("*").alias("copies")), "pii-copies")
    n_texts, copies = copies.count(), copies.where("copies > 1")
    units = stage(_units(texts.select("key1", "key2", F.explode("entities").alias("e")).select("key1", "key2", "e.*").distinct()), "pii-units")
    total = F.lit(float(max(n_texts, 1)))
    least = F.pow(F.col("n_entity") / total, F.lit(1.0 - disclosure))

    # no estimate exceeds the one of a term that stands in the texts of the entity only
    reach = (F.col("n_entity") + smoothing) / least - smoothing
    most = units.agg(F.max(reach)).first()[0] or 0.0
    near = texts.select("key1", "key2", F.explode("words").alias("term")).distinct()
    terms = stage(near.select("term").distinct(), "pii-near-terms")
    once = rows.join(_small(copies), ["key1", "key2"], "left").select(
        F.explode(_words(F.col("text"))).alias("term"), (1.0 / F.coalesce("copies", F.lit(1))).alias("share")
    )
    counts = (
        once.groupBy("term")
        .agg(F.round(F.sum("share")).cast("long").alias("n_term"))
        .where(F.col("n_term") <= most)
        .join(_small(terms), "term", "left_semi")
    )
    held = stage(join_lookup(near, counts, ["term"], ["key1", "key2"]), "pii-held")
    disclosed = stage(_disclosed(held, units, total, least, reach, smoothing), "pii-disclosed")
    listed = words.join(_small(disclosed), "term", "left_semi")
    return stage(listed.groupBy("key1", "key2").agg(F.sort_array(F.collect_set("term")).alias("terms")), "pii-terms")


def _disclosed(
    held: DataFrame, units: DataFrame, total: Column, least: Column, reach: Column, smoothing: float
) -> DataFrame:
    """``(term)`` of the terms that give away enough of an entity."""

    def with_term(name: str, *others: str) -> DataFrame:
        some = units.select("key1", "key2", name, *others).distinct()
        return held.join(_small(some), ["key1", "key2"])

    # no estimate exceeds the one with a part that always comes with the entity
    bound = (F.col("n_both") + smoothing) / (F.col("n_term") + smoothing)
    found = (
        with_term("unit", "part", "kind", "n_entity", "n_part", "n_kind")
        .where(F.col("n_term") <= reach)
        .groupBy("term", "unit", "part", "kind", "n_entity", "n_part", "n_kind", "n_term")
        .agg(F.count("*").alias("n_both"))
        .where(bound >= least)
    )
    for name in ("part", "kind"):
        found = found.join(with_term(name).groupBy("term", name).agg(F.count("*").alias(f"n_with_{name}")), ["term", name])

    def smoothed(n_with: str, expected: Column) -> Column:
        return (F.col(n_with) + smoothing * expected) / (F.col("n_term") + smoothing)

    kind = smoothed("n_with_kind", F.col("n_kind") / total)
    part = smoothed("n_with_part", F.col("n_part") / F.col("n_kind") * kind)
    given = smoothed("n_both", F.col("n_entity") / F.col("n_part") * part)
    return found.where((given >= least) & (given > F.col("n_entity") / total)).select("term").distinct()


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def _named(kind: str, order: int) -> Column:
    """Spans of a kind in a form that sorts by start, then kind as listed."""
    return F.transform(
        kind,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind")
        ),
    )


def find_personal_data(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    disclosure: float = DISCLOSURE,
    smoothing: float = SMOOTHING,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text, base, spans`` and an array per kind.

    ``base`` holds the spans of the patterns and ``spans`` those and the spans of kind
    ``term``: every occurrence, as a whole word, of a term that discloses an entity of any
    text (:func:`disclosing_terms`); neighbouring pairs of scripts without spaces are one span. Both are sorted by start, then kind; offsets are code
    points, ends are exclusive. Null texts count as empty and have no spans; rows that
    repeat an id or a text are marked each.
    """
    terms = disclosing_terms(docs, id_col, text_col, disclosure, smoothing)
    rows = _with_base(docs, id_col, text_col)
    rows = rows.join(F.broadcast(terms) if fits_in_memory(terms) else terms, ["key1", "key2"], "left")
    pair = F.lit(f"^[{_SPACELESS}]")
    whole = F.filter("terms", lambda t: ~F.regexp_like(t, pair))
    first, second = (lambda t: F.substring(t, 1, 1)), (lambda t: F.substring(t, 2, 1))
    letters = F.transform(
        F.filter("terms", lambda t: F.regexp_like(t, pair)),
        lambda t: F.concat(first(t), F.lit("(?="), second(t), F.lit(")|(?<="), first(t), F.lit(")"), second(t)),
    )
    some = F.filter(
        F.array(
            F.when(F.size(whole) > 0, F.concat(F.lit(_LEFT), F.array_join(whole, "|"), F.lit(_RIGHT))),
            F.when(F.size(letters) > 0, F.concat(F.lit("(?:"), F.array_join(letters, "|"), F.lit(")+"))),
        ),
        lambda p: p.isNotNull(),
    )
    pattern = F.concat(F.lit("(?iu)"), F.array_join(some, "|"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    rows = rows.withColumn(
        "term", F.when(F.col("terms").isNotNull(), _matches(F.col("text"), pattern)).otherwise(none)
    )
    base = [_named(k, i) for i, k in enumerate(KINDS)]
    return rows.select(
        "doc_id",
        "text",
        *KINDS,
        F.array_sort(F.concat(*base)).alias("base"),
        F.array_sort(F.concat(*base, _named("term", len(KINDS)))).alias("spans"),
    )


def sanitise(found: DataFrame) -> DataFrame:
    """The rows of :func:`find_personal_data` with ``sanitised``: each span as the name of its kind.

    Of overlapping spans the first is written, and the text up to the end of the last is gone.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        free = span["start"] >= state["at"]
        kept = F.substring("text", state["at"] + 1, span["start"] - state["at"])
        name = F.concat(F.lit("<"), F.upper(span["kind"]), F.lit(">"))
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(free, F.concat(state["out"], kept, name)).otherwise(state["out"]).alias("out"),
        )

    def finish(state: Column) -> Column:
        return F.concat(state["out"], F.substring("text", state["at"] + 1, F.length("text")))

    return found.withColumn("sanitised", F.aggregate("spans", start, step, finish))


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the base spans and all spans in one string."""
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
