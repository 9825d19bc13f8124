"""Text primitives over columns: whitespace, numbered lines, truncation, UD strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from registrum.schemas import LINE

# Unicode white space, with the four separators Java leaves out of \s.
SPACE = r"(?U)[\s\x1c-\x1f]"
SPACE_RUN = SPACE + "+"
EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
STRUCTURAL = r"(?U)^[\s\x1c-\x1f]*(?:# |TABLE: |CODE: )[\s\x1c-\x1f]*[^\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def collapse_whitespace(text: Column) -> Column:
    """Every run of white space becomes one blank; null becomes empty; ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " "))


def clean_markup_text(text: Column) -> Column:
    """HTML-escape text and squeeze line breaks, tabs and blanks to one blank."""
    escaped = F.coalesce(text, F.lit(""))
    # The five escaped characters; the ampersand goes first.
    for raw, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        escaped = F.replace(escaped, F.lit(raw), F.lit(entity))
    return F.regexp_replace(escaped, r"[\n\r\t ]+", " ")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


def parse_numbered(markdown: Column) -> Column:
    """``"[1] a\\n[2] b"`` to ``[(1, a), (2, b)]``; lines without a number are dropped.

    Patterns are looked for in a line's number and, behind it, in the first character only.
    """
    lines = F.split(F.coalesce(markdown, F.lit("")), "\n")
    numbered = F.filter(
        lines,
        lambda raw: raw.startswith("[")
        & raw.contains("]")
        & F.substring_index(raw, "]", 1).rlike(r"^\[[0-9]+\z"),
    )

    def behind(raw: Column) -> Column:
        text = F.ltrim(F.substring(raw, F.length(F.substring_index(raw, "]", 1)) + 2, F.lit(2147483647)))
        return F.when(F.substring(text, 1, 1).rlike(SPACE), F.regexp_replace(text, "(?U)^[\\s\\x1c-\\x1f]+", "")).otherwise(text)

    return F.transform(
        numbered,
        lambda raw: F.struct(
            F.substring(F.substring_index(raw, "]", 1), 2, 2147483647).try_cast("int").alias("num"),
            behind(raw).alias("text"),
        ),
    ).cast(f"array<{LINE}>")


def number_lines(lines: Column) -> Column:
    """Array of texts to numbered text, one line each, counted from 1."""
    return F.array_join(
        F.transform(lines, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n"
    )


def is_structural(text: Column) -> Column:
    """Headings, tables and code blocks, recognised by their rendered prefix with something behind it."""
    return text.rlike(STRUCTURAL)


def truncate(text: Column, limit: int, suffix: str = "...") -> Column:
    """Cut to ``limit`` characters and mark the cut."""
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit), F.lit(suffix))
    )


def truncate_utf16(text: Column, limit: int, suffix: str = "…") -> Column:
    """As :func:`truncate`, measured in UTF-16 code units as a browser does.

    A character beyond the basic plane counts twice and is not cut in half.
    Only rows holding such a character pay for the second measure.
    """
    wide = text.rlike("[\\x{10000}-\\x{10FFFF}]")
    units = F.length(text) + F.length(F.regexp_replace(text, "[^\\x{10000}-\\x{10FFFF}]", ""))
    doubled = F.regexp_replace(text, "([\\x{10000}-\\x{10FFFF}])", "\u0000$1")
    cut = F.replace(F.substring(doubled, 1, limit), F.lit("\u0000"), F.lit(""))
    return (
        F.when(~wide, truncate(text, limit, suffix))
        .when(units <= limit, text)
        .otherwise(F.concat(cut, F.lit(suffix)))
    )


def parse_feats(feats: Column) -> Column:
    """UD feature string to (key, value) pairs; items without ``=`` are dropped, repeats kept."""
    items = F.filter(
        F.split(F.coalesce(feats, F.lit("")), "[|]"), lambda item: F.instr(item, "=") > 0
    )
    return F.transform(
        items,
        lambda item: F.struct(
            F.substring_index(item, "=", 1).alias("key"),
            F.regexp_replace(item, "(?s)^[^=]*=", "").alias("value"),
        ),
    )


def safe_name(prefix: str, name: Column) -> Column:
    """Column name for a tag: separators become underscores."""
    return F.regexp_replace(F.concat(F.lit(prefix + "_"), name), "[:=|]", "_")


def display_factor(name: Column) -> Column:
    """``F1`` to ``Dimension 1``; other names stay."""
    return F.regexp_replace(name, "^F([0-9]+)$", "Dimension $1")
