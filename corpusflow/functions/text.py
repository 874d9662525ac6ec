"""Text columns: whitespace, tokens, lexical overlap, snippets."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 characters that count as whitespace (Unicode whitespace plus the
# separators U+001C to U+001F). The regex shorthand \s covers neither set.
WHITESPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"

# The same characters one by one: replacing them and splitting at spaces takes half the time of the class as a regex.
WHITESPACE_CHARACTERS = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000
)))

ELLIPSIS = "…"


def spaced(text: Column) -> Column:
    """Every whitespace character becomes a space."""
    return F.translate(text, WHITESPACE_CHARACTERS, " " * len(WHITESPACE_CHARACTERS))


def strip(text: Column) -> Column:
    """Remove whitespace from both ends."""
    return F.regexp_replace(text, rf"\A{WHITESPACE}|{WHITESPACE}\z", "")


def collapse_whitespace(text: Column) -> Column:
    """Every run of whitespace becomes one space, none at the ends."""
    return F.trim(F.regexp_replace(spaced(text), " +", " "))


def words(text: Column) -> Column:
    """Lower-cased whitespace-separated words, in order, repeats kept."""
    return F.array_remove(F.split(spaced(F.lower(text)), " "), "")


def tokens(text: Column) -> Column:
    """Distinct words; punctuation stays attached."""
    return F.array_distinct(words(text))


def lexical_score(query: Column, document: Column) -> Column:
    """Share of the query's distinct words that occur in the document (0.0 for no words)."""
    asked = tokens(F.coalesce(query, F.lit("")))
    # The intersection has each word once, so the document's repeats need not be removed.
    found = F.array_intersect(asked, words(F.coalesce(document, F.lit(""))))
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(F.size(found) / F.size(asked))


def snippet(text: Column, max_chars: int = 280) -> Column:
    """One line of at most `max_chars` characters, the last being an ellipsis when cut."""
    line = collapse_whitespace(F.coalesce(text, F.lit("")))
    cut = F.concat(F.rtrim(F.substring(line, 1, max_chars - 1)), F.lit(ELLIPSIS))
    return F.when(F.length(line) <= max_chars, line).otherwise(cut)


def present(text: Column) -> Column:
    """The text, or null when it is empty."""
    return F.nullif(text, F.lit(""))
