"""Column helpers for text: tokens, strip, path suffix. All of them stay inside JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: word characters as the reference's tokenizer sees them (letters, numbers, underscore).
WORD = r"[\p{L}\p{N}_]+"
# Fixed value: the white space of Python's str.strip.
SPACE_CLASS = r"[\s\x1c-\x1f]"


def tokens(text: Column) -> Column:
    """Lower-cased runs of word characters; NULL text gives NULL."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def strip(text: Column) -> Column:
    """Python's str.strip: removes Unicode white space and U+001C..U+001F at both ends."""
    return F.regexp_replace(text, rf"(?U)^{SPACE_CLASS}+|{SPACE_CLASS}+\z", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)[^\s\x1c-\x1f]")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Suffix with its dot as pathlib defines it; '' for none (leading-dot names, trailing dots)."""
    return F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1)


def line_count(text: Column) -> Column:
    """Lines as a binary line iterator counts them: an unterminated last line counts, an empty text has none."""
    t = F.coalesce(text, F.lit(""))
    newlines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return F.when(t == "", F.lit(0)).otherwise(newlines + F.when(F.endswith(t, F.lit("\n")), 0).otherwise(1)).cast("bigint")
