"""Text cleaning and keys, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .html import html_to_text

# Character classes with Unicode meaning, valid in java.util.regex and in RE2 alike.
SPACE = r"\t-\r\x1c-\x1f\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"

# Every character that counts as white space, for trimming both ends.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

ARTEFACT_MIN_LENGTH = 10
ARTEFACT_MAX_LENGTH = 5000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Trim Unicode white space, which plain ``trim`` does not."""
    return F.trim(text, F.lit(SPACE_CHARS))


def words(text: Column) -> Column:
    """White-space separated words; an empty array for a blank text."""
    bare = strip(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+"))


def utf8_text(text: Column) -> Column:
    """Drop bytes that are not valid UTF-8."""
    repaired = F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(repaired)


def clean_text(text: Column) -> Column:
    """Corpus cleaning: markup to text, fenced code and markdown marks out, white space collapsed."""
    plain = F.when(F.contains(text, F.lit("<")) & F.contains(text, F.lit(">")), html_to_text(text)) \
        .otherwise(text)
    unfenced = let(plain, lambda t: F.when(
        F.contains(t, F.lit("```")), F.regexp_replace(t, r"(?s)```.*?```", " ")).otherwise(t))
    # Marks become a space and runs of spaces become one, so one class does both.
    return F.trim(F.regexp_replace(unfenced, f"[#*_>`{SPACE}]+", " "))


def dedup_text(text: Column) -> Column:
    """Text that duplicates share: lower case, single spaces, then punctuation removed.

    The spaces are collapsed before the punctuation goes, so ``a - b`` keeps two of them.
    """
    spaced = F.regexp_replace(F.lower(text), f"[{SPACE}]+", " ")
    return F.trim(F.regexp_replace(spaced, f"[^{WORD} ]+", ""))


def dedup_key(text: Column) -> Column:
    return F.md5(dedup_text(text))


def clean_artefacts(text: Column, confusables: bool = True, min_length: int = ARTEFACT_MIN_LENGTH,
                    max_length: int = ARTEFACT_MAX_LENGTH) -> Column:
    """Clean recognised text: single spaces, look-alike characters, length limits."""
    joined = strip(F.regexp_replace(text, f"[{SPACE}]+", " "))
    if confusables:
        joined = F.translate(joined, "|01", "IOl")
    return let(joined, lambda t: F.when(F.length(t) < min_length, F.lit(""))
               .otherwise(F.trim(F.substring(t, 1, max_length))))


def path_suffix(path: Column) -> Column:
    """Lower-cased suffix without the dot; compressed tarballs keep both parts."""
    name = F.lower(F.substring_index(path, "/", -1))
    return F.when(F.endswith(name, F.lit(".tar.gz")), F.lit("tar.gz")) \
        .otherwise(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))


def path_stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"^(.+)\.[^.]*$", "$1")


def relative_path(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 30)) \
        .otherwise(path)


def percentage(part: Column, whole: Column) -> Column:
    """``part / whole * 100``, 0 where the whole is not positive."""
    share = part.cast("double") / F.nullif(whole, F.lit(0)).cast("double") * 100
    return F.when(whole > 0, share).otherwise(F.lit(0.0))
