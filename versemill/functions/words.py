"""Stop-word lists.

``ENGLISH`` is the English list that ships with Spark's ``StopWordsRemover``. Larger lists
are passed as the ``base`` of a combined list. Matching is case sensitive, as in the
pipelines these lists were made for: ``"I"`` and ``"STR"`` never match lower-cased text.
"""

from __future__ import annotations

from collections.abc import Iterable

# Spark's English stop words.
ENGLISH = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by",
    "for", "with", "about", "against", "between", "into", "through", "during", "before",
    "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will",
    "just", "don", "should", "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll",
    "i'd", "you'd", "he'd", "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's",
    "it's", "we're", "they're", "i've", "we've", "you've", "they've", "isn't", "aren't",
    "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't",
    "wouldn't", "shan't", "shouldn't", "mustn't", "can't", "couldn't", "cannot", "could",
    "here's", "how's", "let's", "ought", "that's", "there's", "what's", "when's", "where's",
    "who's", "why's", "would",
)

# Words and spoken forms frequent in any lyrics.
COMMON = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "he", "her",
    "his", "I", "in", "is", "it", "me", "my", "of", "on", "or", "she", "so",
    "that", "the", "to", "up", "was", "we", "with", "you", "i'm", "i've", "i'll", "i'd",
    "i", "im", "it's", "its", "don't", "dont", "i’m", "i’ve", "i’ll", "i’d", "it’s", "don’t",
)

# Words without content in rap lyrics.
RAP = (
    "ain't", "yeah", "yea", "yo", "uh", "huh", "gonna", "wanna", "hey", "ooh", "woo",
    "nah", "got", "gotcha", "cuz", "y'all", "imma", "lil", "flex",
)

# Additions for the phrase pipeline.
PHRASE_EXTRAS = (
    "br", "space", "b", "are", "the", "we", "mine", "by", "come", "STR", "much", "etc",
    "s", "note", "make", "i", "'", "n't", "'s",
)

# Onomatopoeia and remnants of lemmatisation.
ONOMATOPOEIA = (
    "ooh", "yeah", "hey", "whoa", "woah", "ohh", "was", "mmm", "oooh", "yah", "yeh",
    "hmm", "deh", "doh", "jah", "wa",
)

# Terms that recur in every topic.
RECURRENT = ("like", "know", "come", "get", "got", "go", "to", "oh", "yeah", "la")


def union(*lists: Iterable[str]) -> tuple[str, ...]:
    """The distinct words of several lists, in order of first mention."""
    return tuple(dict.fromkeys(word for words in lists for word in words))


def default_words(base: Iterable[str] = ENGLISH) -> tuple[str, ...]:
    """For the default pipeline."""
    return union(base)


def noun_words(base: Iterable[str] = ENGLISH) -> tuple[str, ...]:
    """For the noun pipeline: the base list, common and rap words."""
    return union(base, COMMON, RAP)


def phrase_words(base: Iterable[str] = ENGLISH) -> tuple[str, ...]:
    """For the phrase pipeline: the base list and its additions."""
    return union(base, PHRASE_EXTRAS)


def v2_words(base: Iterable[str] = ENGLISH) -> tuple[str, ...]:
    """For the second topic pipeline: the base list and onomatopoeia."""
    return union(base, ONOMATOPOEIA)


def ngram_words(base: Iterable[str] = ENGLISH) -> tuple[str, ...]:
    """For the n-gram pipeline: the base list and recurrent terms."""
    return union(base, RECURRENT)
