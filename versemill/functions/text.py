"""Text cleaning and tokenisation as Column expressions.

Word characters are letters, numbers and the underscore of any script; white space is the
Unicode set as well. Java's ``\\w`` and ``\\s`` cover ASCII only, so the classes are spelled
out. Quantifiers are possessive where a long run could otherwise be scanned repeatedly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}"
# punctuation that separates words (all but the underscore and its relatives) and symbols
SEPARATOR = r"\p{Pd}\p{Ps}\p{Pe}\p{Pi}\p{Pf}\p{Po}\p{S}"

# a run of word characters that holds a digit
_WORD_WITH_DIGIT = rf"(?<![{WORD}])[{WORD}&&[^\p{{Nd}}]]*+\p{{Nd}}[{WORD}]*+"

# Contractions that the Penn Treebank convention splits in two.
TREEBANK_CONTRACTIONS = (
    ("can", "not"),
    ("gim", "me"),
    ("gon", "na"),
    ("got", "ta"),
    ("lem", "me"),
    ("wan", "na"),
)

# English clitics cut off before the alphabetic test.
CLITICS = ("n't", "'s", "'re", "'ve", "'ll", "'d", "'m")


def clean_text(text: Column, newline: str = " ", drop_parentheses: bool = True) -> Column:
    """Lower-case text without punctuation, bracketed markers and words with digits."""
    out = F.replace(text, F.lit("\n"), F.lit(newline))
    out = F.regexp_replace(out, r"[,.!?]", "")
    out = F.regexp_replace(out, r"\[[^\n\]]*+\]", " ")
    out = F.regexp_replace(out, _WORD_WITH_DIGIT, " ")
    if drop_parentheses:
        out = F.regexp_replace(out, r"[()]", " ")
    return F.lower(out)


def clean_text_compact(text: Column) -> Column:
    """The variant that joins lines without a space and keeps parentheses."""
    return clean_text(text, newline="", drop_parentheses=False)


def strip_singles_and_symbols(text: Column) -> Column:
    """Remove one-character words, then all but word characters and white space."""
    out = F.regexp_replace(text, rf"(?<![{WORD}])[{WORD}](?![{WORD}])", "")
    return F.regexp_replace(out, rf"[^{WORD}{SPACE}]", "")


def tokenize_whitespace(text: Column) -> Column:
    """Split on runs of white space."""
    return F.filter(F.split(text, rf"[{SPACE}]+"), lambda t: t != "")


def tokenize_words(text: Column) -> Column:
    """Lower-cased runs of word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"([{WORD}]+)"), 1)


def tokenize_simple(text: Column, min_length: int = 2, max_length: int = 15) -> Column:
    """Lower-cased runs of word characters without digits, within a length range."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{Nl}\p{No}_]+)"), 1)
    return F.filter(
        runs,
        lambda t: F.char_length(t).between(min_length, max_length) & ~t.startswith("_"),
    )


def tokenize_treebank(text: Column) -> Column:
    """Lower-cased words with the closed contractions split; punctuation must be gone."""
    heads = "|".join(rf"{a}(?={b}(?![{WORD}]))" for a, b in TREEBANK_CONTRACTIONS)
    return tokenize_whitespace(F.regexp_replace(F.lower(text), rf"(?<![{WORD}])({heads})", "$1 "))


def tokenize_alpha(text: Column) -> Column:
    """Words of letters only; clitics are cut off first."""
    tails = "|".join(c.replace("'", "['’]") for c in CLITICS)
    cut = F.regexp_replace(text, rf"(?i)({tails})(?![{WORD}])", " ")
    return F.filter(
        F.split(cut, rf"[{SPACE}{SEPARATOR}]+"),
        lambda t: t.rlike(r"^\p{L}+$"),
    )


def filter_token_length(tokens: Column, min_length: int = 3, drop_numeric: bool = True) -> Column:
    """Keep tokens of at least ``min_length`` characters that are not plain numbers."""

    def wanted(t: Column) -> Column:
        long_enough = F.char_length(t) >= min_length
        return long_enough & ~t.rlike(r"^\p{N}+$") if drop_numeric else long_enough

    return F.filter(tokens, wanted)


def remove_stop_words(tokens: Column, words: Sequence[str]) -> Column:
    """Drop the tokens found in a word list; repeats of other tokens stay."""
    listed = sorted(set(words))
    return F.filter(tokens, lambda t: ~t.isin(listed))


def keep_alpha(tokens: Column) -> Column:
    """Keep tokens of letters only."""
    return F.filter(tokens, lambda t: t.rlike(r"^\p{L}+$"))
