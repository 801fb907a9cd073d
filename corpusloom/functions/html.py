"""HTML to plain text without leaving the JVM."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column, functions as F, types as T

# The rest of a tag: a quoted value may hold the mark that else ends the tag; a quote that is not closed is a character.
_REST = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+>"""
# All markup in one pass from left to right, so that a comment in an attribute, or a tag in a comment or a
# script, is no markup. Tags inside a title or text area are text, which is kept as it is (groups 1 and 2);
# a script or style that is not closed goes on to the end.
MARKUP = (
    r"(?is)<!--.*?-->"
    rf"|<script\b{_REST}(?:.*?</script\b[^>]*+>|.*+)|<style\b{_REST}(?:.*?</style\b[^>]*+>|.*+)"
    rf"|<template\b{_REST}.*?</template\b[^>]*+>"
    rf"|<title\b{_REST}(.*?)</title\b[^>]*+>|<textarea\b{_REST}(.*?)</textarea\b[^>]*+>"
    rf"|<[!?/a-z]{_REST}"
)
ENTITY = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
# Numbers of control characters that stand for the characters Windows-1252 has there (five have none).
_WINDOWS = {str(code): text for code in range(128, 160) if (text := bytes([code]).decode("cp1252", "ignore"))}


def _constant_map(table: dict[str, str]) -> Column:
    """One literal that folds to a constant map, where a map constructor has two expressions per entry."""
    return F.from_json(F.lit(json.dumps(table)), T.MapType(T.StringType(), T.StringType()))


def _named_entities() -> Column:
    """All names of the HTML standard that end in a semicolon; some stand for two characters."""
    return _constant_map({name[:-1]: text for name, text in html.entities.html5.items() if name.endswith(";")})


def _from_code_point(code: Column, windows: Column) -> Column:
    usable = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    remapped = F.when(code.between(128, 159), F.try_element_at(windows, code.cast("string")))
    return F.when(remapped.isNotNull(), remapped).when(usable, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")) \
        .otherwise(F.lit("\ufffd"))


def _decode_entity(entity: Column, names: Column, windows: Column) -> Column:
    body = F.substring(entity, F.lit(2), F.length(entity) - 2)
    # Without leading zeros; more digits than any character needs give no number.
    digits = F.regexp_extract(body, "^#[xX]?0*(.*)$", 1)
    hexa = F.when(F.length(digits) <= 6, F.conv(F.concat(F.lit("0"), digits), 16, 10).cast("bigint"))
    deci = F.when(F.length(digits) <= 7, F.concat(F.lit("0"), digits).try_cast("bigint"))
    return (
        F.when(F.startswith(F.lower(body), F.lit("#x")), _from_code_point(hexa, windows))
        .when(F.startswith(body, F.lit("#")), _from_code_point(deci, windows))
        .otherwise(F.coalesce(F.try_element_at(names, body), entity))
    )


def decode_entities(text: Column) -> Column:
    """Decode named and numeric entities in one pass; unknown names stay as they are.

    Numbers from 128 to 159 are Windows-1252, numbers of no character U+FFFD, with any number of digits.
    """
    names, windows = _named_entities(), _constant_map(_WINDOWS)
    pieces = F.split(text, ENTITY)
    entities = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    decoded = F.zip_with(pieces, entities, lambda p, e: F.concat(
        p, F.coalesce(_decode_entity(e, names, windows), F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(decoded, "")).otherwise(text)


def html_to_text(html_text: Column) -> Column:
    """Text of a page: script, style, template and comments dropped, tags stripped, entities decoded."""
    return decode_entities(F.regexp_replace(html_text, MARKUP, "$1$2"))
