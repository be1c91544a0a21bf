"""Column functions on text: white space, lines, tokens and trigrams.

Trimming, word and blank classes follow Unicode, as text from many languages needs; Spark's own trim()
knows the ASCII space only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line boundaries of Unicode text, a carriage return before a line feed with it.
LINE_BREAK = "\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+", "")


def blank_to_null(text: Column) -> Column:
    """Null for an empty string."""
    return F.when(text != "", text)


def split_lines(text: Column) -> Column:
    """The lines of a text at any Unicode line boundary; a final boundary opens no line, an empty text has none."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores of any script, in order: what embeddings and trigrams are made of."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script, in order: the `simple` analyzer's terms."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def word_trigrams(word: Column) -> Column:
    """The three-letter windows of a word padded with two blanks before and one after, in order."""
    padded = F.concat(F.lit("  "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))


#: Three letters ahead, of which the last two are not both blanks; one letter is passed.
_WINDOW = r"(?s)(?=(..[^ ]|.[^ ] ))."


def _windows(words: Column) -> Column:
    """All words' trigrams, by one expression over the words set apart by blanks instead of functions for each letter."""
    apart = F.concat(F.lit("  "), F.array_join(words, "   "), F.lit(" "))
    return F.regexp_extract_all(apart, F.lit(_WINDOW), 1)


def trigrams(text: Column) -> Column:
    """All words' trigrams, in order and with repeats."""
    return _windows(tokens(text))


def trigram_set(text: Column) -> Column:
    """The distinct trigrams, in the order of their first places."""
    return F.array_distinct(_windows(F.array_distinct(tokens(text))))


def spaced(text: Column) -> Column:
    """The tokens, with two blanks before the first, three between two and one at the end: it holds a trigram exactly where a token has it."""
    return F.concat(F.lit("  "), F.array_join(tokens(text), "   "), F.lit(" "))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared elements over all elements of two sets; 0 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))
