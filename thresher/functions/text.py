"""Text functions as Catalyst expressions; all stay in the JVM and need no shuffle.

Null texts have no tokens. Every function of a column takes a Column or a column's name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII marks that a space replaces; the backslash is not among them.
PUNCTUATION = "[!\"#$%&'()*+,\\-./:;<=>?@\\[\\]^_`{|}~]+"
#: The same with white space.
BREAKS = PUNCTUATION.removesuffix("]+") + r"\s]+"
#: Contractions that the tokenizer splits in two. Fixed values.
CONTRACTIONS = {"cannot": "can not", "gonna": "gon na", "gotta": "got ta", "wanna": "wan na", "gimme": "gim me", "lemme": "lem me"}
#: English function words.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have "
    "having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same "
    "she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will "
    "with you your yours yourself yourselves"
).split()
#: Digit of each letter from A to Z. Fixed values.
SOUNDEX_DIGITS = "01230120022455012623010202"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

Text = Column | str


def _col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise(text: Text) -> Column:
    """Punctuation to space, then lower case."""
    return F.lower(F.regexp_replace(_col(text), PUNCTUATION, " "))


def tokens(text: Text, contractions: bool = False) -> Column:
    """Words of a normalised text in order; a word's place in the array is its position. Punctuation and white space go in
    one pass, so that what is left to split at is one character."""
    clean = F.lower(F.regexp_replace(_col(text), BREAKS, " "))
    if contractions:
        for whole, parts in CONTRACTIONS.items():
            clean = F.regexp_replace(clean, rf"\b{whole}\b", parts)
    return F.coalesce(F.filter(F.split(clean, " "), lambda x: x != ""), F.array().cast("array<string>"))


def raw_tokens(text: Text) -> Column:
    """Words as written: neither case nor punctuation is changed."""
    return F.coalesce(F.filter(F.split(_col(text), r"\s+"), lambda x: x != ""), F.array().cast("array<string>"))


def segments(text: Text, words: list[str], search: bool = False) -> Column:
    """Texts without spaces as words of a dictionary, by forward maximum matching: at each place the longest word, else a
    run of letters a-z and digits, else one character; white space separates. search: before a longer word come the
    words of the dictionary of two and of three characters inside it. The dictionary is part of the expression: for
    some thousands of words."""
    known = sorted({w for w in words if w and not re.search(r"\s", w)}, key=lambda w: (-len(w), w))
    pattern = "|".join([*(re.sub(r"([^\w])", r"\\\1", w) for w in known), "[a-zA-Z0-9]+", r"\S"])
    found = F.coalesce(F.regexp_extract_all(_col(text), F.lit(f"({pattern})"), F.lit(1)), F.array().cast("array<string>"))
    if not search:
        return found

    def inner(w: Column, n: int) -> Column:
        some = [x for x in known if len(x) == n]
        if not some:
            return F.array().cast("array<string>")
        parts = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))
        return F.when(F.char_length(w) > n, F.filter(parts, lambda x: x.isin(some))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(found, lambda w: F.concat(inner(w, 2), inner(w, 3), F.array(w))))


def distinct_terms(text: Text, stop_words: list[str] | None = None) -> Column:
    """The set of a document's words without stop words, sorted."""
    found = F.array_distinct(tokens(text))
    stop = STOP_WORDS if stop_words is None else stop_words
    return F.sort_array(F.array_except(found, F.array(*map(F.lit, stop))) if stop else found)


def content_words(text: Text, shortest: int = 2, stop_words: list[str] | None = None) -> Column:
    """Words in order, without stop words and short ones."""
    stop = STOP_WORDS if stop_words is None else stop_words
    return F.filter(tokens(text), lambda x: (F.char_length(x) >= shortest) & ~x.isin(stop))  # looked up in a hash set


def positions(terms: Text, term: str) -> Column:
    """0-based positions of a word in an array of words."""
    return F.filter(F.transform(_col(terms), lambda x, i: F.when(x == term, i)), lambda i: i.isNotNull())


def has_phrase(terms: Text, words: list[str]) -> Column:
    """Whether words follow one another in an array of words. Words hold no space, so the joined text tells; no phrase
    is in every document."""
    if not words:
        return F.lit(True)
    return F.contains(F.concat(F.lit(" "), F.array_join(_col(terms), " "), F.lit(" ")), F.lit(f" {' '.join(words)} "))


def kgrams(word: Text, k: int = 3) -> Column:
    """All k-character windows of $word$; of a shorter one the whole; of an empty word none."""
    w = _col(word)
    marked = F.concat(F.lit("$"), w, F.lit("$"))
    return F.when(F.char_length(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(marked) - (k - 1))), lambda i: F.substring(marked, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Text, b: Text) -> Column:
    """Of two arrays as sets; of two empty ones 0."""
    both = F.size(F.array_union(_col(a), _col(b)))
    return F.when(both > 0, F.size(F.array_intersect(_col(a), _col(b))) / both).otherwise(0.0)


def soundex(word: Text, size: int = 4) -> Column:
    """First letter, then digits of the rest: equal neighbours are one, vowels and h and w part neighbours, zeros go. Only
    A-Z count; without letters all zeros."""
    letters = F.upper(F.regexp_replace(_col(word), "[^A-Za-z]", ""))
    digits = F.translate(letters, LETTERS, SOUNDEX_DIGITS)
    for d in "0123456":
        digits = F.regexp_replace(digits, f"{d}+", d)
    code = F.concat(F.substring(letters, 1, 1), F.replace(F.substring(digits, 2, 1 << 20), F.lit("0"), F.lit("")))
    return F.substring(F.rpad(code, size, "0"), 1, size)


def rotations(word: Text) -> Column:
    """w[i:] + w[:i] for every i; of an empty word none."""
    w = _col(word)
    return F.when(F.char_length(w) > 0, F.transform(F.sequence(F.lit(1), F.char_length(w)), lambda i: F.concat(F.substring(w, i, F.char_length(w)), F.substring(w, F.lit(1), i - 1)))).otherwise(F.array().cast("array<string>"))


def span(words: Text, start: Text, end: Text, glue: str = "") -> Column:
    """The words from start to end, both included, joined."""
    s, e = _col(start), _col(end)
    return F.array_join(F.slice(_col(words), s + 1, F.greatest(e - s + 1, F.lit(0))), glue)


def runs(words: Text, size: int) -> Column:
    """An array of words as an array of runs of size words, of which the last may be shorter. Exploded, a row holds its
    run alone, where an exploded number beside the array would carry all words into every row. Words are taken one by
    one: a slice copies the whole array each time."""
    w = _col(words)
    starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.ceil(F.size(w) / size).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.transform(F.sequence(k * size, F.least(k * size + (size - 1), F.size(w) - 1)), lambda i: F.get(w, i)))


def find_sequence(pattern: Text, sequence: Text) -> Column:
    """The first 0-based index of an array in another, -1 if none."""
    p, s = _col(pattern), _col(sequence)
    starts = F.when(F.size(s) >= F.size(p), F.sequence(F.lit(0), F.size(s) - F.size(p))).otherwise(F.array().cast("array<int>"))
    hits = F.filter(starts, lambda i: F.slice(s, i + 1, F.size(p)) == p)
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(-1))


def bigrams(terms: Text) -> Column:
    """Neighbouring words as an array of (w1, w2)."""
    t = _col(terms)
    return F.zip_with(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("w1"), b.alias("w2")))
