"""Text functions of the search: cleaning, terms, negation, substring matches."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that the results depend on.
GENERIC_TERMS = ("畫面", "段落", "片段")
STOP_CHARACTERS = "的了在是這那個有跟和與上中一準備出現連續喊著地正要"
CLAUSE_MARKS = "，。！？、"
NEGATIONS = ("不要", "沒有", "不是", "並非")
PLACEHOLDERS = ("null", "none", "n/a", "na", "無", "-")
#: White space as Python's str.split() knows it.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once a row however often use names it: a plan writes a column out at each place that names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_blank(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def strip_generic_terms(query: Column) -> Column:
    """The query without generic words; as it was if nothing else is left."""

    def without(q: Column) -> Column:
        cleaned = q
        for term in GENERIC_TERMS:
            cleaned = F.replace(cleaned, F.lit(term), F.lit(""))
        return bound(strip_blank(cleaned), lambda c: F.when(c != "", c).otherwise(q))

    return bound(query, without)


def extract_terms(query: Column) -> Column:
    """Candidate keywords: runs of ASCII letters and digits first, then the other text cut at stop characters, white space and
    clause marks; those of two or more characters, each once, in order."""
    words = F.regexp_extract_all(query, F.lit("([A-Za-z0-9]+)"), 1)
    # one class of characters: repeated alternatives would take a stack frame for each character of a long text
    rest = F.split(query, f"[A-Za-z0-9{STOP_CHARACTERS}{CLAUSE_MARKS}{BLANK[1:-1]}]+")
    return F.array_distinct(F.filter(F.concat(words, rest), lambda t: F.length(t) >= 2))


_NEGATED = "(?:" + "|".join(NEGATIONS) + f")([^{CLAUSE_MARKS}]*)"


#: Each character of a negation: the first of its marker, or one right after another of them.
_IN_NEGATION = "(?:(?=" + "|".join(NEGATIONS) + rf")|(?!^)\G)[^{CLAUSE_MARKS}]"


def positive_text(query: Column) -> Column:
    """The query with spaces in place of each negation up to the next clause mark."""
    return F.regexp_replace(query, _IN_NEGATION, " ")


def negative_text(query: Column) -> Column:
    """What the negations of the query exclude, joined by a space; '' without any."""
    return F.array_join(F.regexp_extract_all(query, F.lit(_NEGATED), 1), " ")


def bigrams(term: Column) -> Column:
    """The term's pieces of two characters, each once, in order."""
    n = F.length(term)
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(term, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def grams(text: Column, n: int = 3) -> Column:
    """The distinct pieces of n characters; one pass over the text, by a look-ahead at each place."""
    character = r"[\x{0}-\x{D7FF}\x{E000}-\x{10FFFF}]"  # never half of a pair
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({character}{{{n}}}))"), 1))


def contains_ci(text: Column, term: Column) -> Column:
    """Whether the text holds the term, whatever their case; every character of the term stands for itself."""
    return F.contains(F.lower(text), F.lower(term))


def term_frequency(text: Column, term: Column) -> Column:
    """How often the term occurs without overlap, from the length that is lost with it."""
    left = F.replace(F.lower(text), F.lower(term), F.lit(""))
    return (F.length(text) - F.length(left)).cast("double") / F.greatest(F.length(term), F.lit(1))


def clean_text(text: Column) -> Column:
    """White space collapsed, and '' for null and for words that stand for nothing."""
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{BLANK}+", " "))
    return bound(one, lambda t: F.when(F.lower(t).isin(*PLACEHOLDERS), "").otherwise(t))


def has_text(c: Column | str) -> Column:
    """Null and '' both mean that there is none."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) != ""


def first_text(*columns: str) -> Column:
    """The first of the texts that isn't empty, else ''."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(""))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility-normalised text with white space collapsed."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()))


@F.pandas_udf(T.StructType([T.StructField("word", T.StringType()), T.StructField("share", T.DoubleType())]))
def _dominant_word(text: pd.Series) -> pd.DataFrame:
    def best(t: str | None) -> tuple[str | None, float]:
        words = Counter((t or "").lower().split())  # in order of first occurrence, which decides between equals
        word = max(words, key=words.__getitem__, default=None)
        return word, words[word] / words.total() if words else 0.0

    return pd.DataFrame([best(t) for t in text], columns=["word", "share"])


#: Called once a row: a plan may move or repeat what it takes for pure.
_dominant_word = _dominant_word.asNondeterministic()


def dominant_word(text: Column) -> Column:
    """struct(word, share): the most frequent lower-cased word, of equals the first to occur, and its share; null and 0 without
    words. One count of a text's words, in Arrow batches."""
    return _dominant_word(text)


def append_history(history: Column, line: Column, most: int = 800) -> Column:
    """The history with another line, its last `most` characters."""
    return F.right(F.when(F.coalesce(history, F.lit("")) == "", line).otherwise(F.concat(history, F.lit("\n"), line)), F.lit(most))
