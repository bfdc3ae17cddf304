"""Full-text search over arrays of lexemes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of English vectors.
STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lexemes(text) -> Column:
    """Words in order, small letters; stop words keep their place as nulls."""
    words = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(words, lambda w: F.when(~w.isin(STOP), w))


def to_tsvector(text) -> Column:
    """``array<struct<lexeme, positions>>`` by lexeme; positions count all words from 1."""
    placed = F.filter(F.transform(lexemes(text), lambda w, i: F.struct(w.alias("lexeme"), (i + 1).alias("at"))), lambda s: s["lexeme"].isNotNull())
    unique = F.array_sort(F.array_distinct(placed["lexeme"]))
    return F.transform(unique, lambda w: F.struct(w.alias("lexeme"), F.filter(placed, lambda s: s["lexeme"] == w)["at"].alias("positions")))


def matches(text, query: str) -> Column:
    """``to_tsvector(text) @@ to_tsquery(query)`` with ``&``, ``|``, ``!``, parentheses and ``:*`` prefixes."""
    import re

    tokens = re.findall(r"[&|!()]|[\w]+(?::\*)?", query.lower())
    words = F.array_distinct(F.filter(lexemes(text), lambda w: w.isNotNull()))
    at = [0]

    def atom():
        t = tokens[at[0]]
        at[0] += 1
        if t == "(":
            e = either()
            at[0] += 1
            return e
        if t == "!":
            return ~atom()
        if t.endswith(":*"):
            return F.exists(words, lambda w: w.startswith(t[:-2]))
        return F.array_contains(words, t)

    def both():
        e = atom()
        while at[0] < len(tokens) and tokens[at[0]] == "&":
            at[0] += 1
            e = e & atom()
        return e

    def either():
        e = both()
        while at[0] < len(tokens) and tokens[at[0]] == "|":
            at[0] += 1
            e = e | both()
        return e

    return either()


def rank(text, words: list[str]) -> Column:
    """Occurrences of the words over the length of the text."""
    own = lexemes(text)
    return F.coalesce(F.try_divide(F.size(F.filter(own, lambda w: w.isin(words))).cast("double"), F.size(own)), F.lit(0.0))


def headline(text, words: list[str], start: str = "<b>", stop: str = "</b>") -> Column:
    return F.regexp_replace(_c(text), rf"(?i)\b({'|'.join(words)})\b", f"{start}$1{stop}")
