"""What a file name says: language, parser code, merge group, display language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File prefix to parser language code.
PARSER_CODES = {
    "cmn_Hant": "zh",
    "cmn_Hans": "zh",
    "eng_Latn": "en",
    "swe_Latn": "sv",
    "pes_Arab": "fa",
    "fin_Latn": "fi",
}
# File prefix to display language.
DISPLAY_LANGUAGES = {
    "cmn_Hans": "Mandarin",
    "cmn_Hant": "Mandarin",
    "eng_Latn": "English",
    "fin_Latn": "Finnish",
    "pes_Arab": "Persian",
    "swe_Latn": "Swedish",
}
# Script variants analysed as one group.
MERGE_GROUPS = {"cmn_Hant": "cmn", "cmn_Hans": "cmn"}
# Tasks evaluated per language.
TASK_CAP = 250
TASK_CAPS = {"swe_Latn": 100}
# Presentation of a language (colour, name), then fallback colours.
LANGUAGE_STYLES = {
    "eng_Latn": ("#4363d8", "English"),
    "fin_Latn": ("#3cb44b", "Finnish"),
    "cmn": ("#e6194b", "Mandarin"),
    "swe_Latn": ("#f58231", "Swedish"),
    "pes_Arab": ("#911eb4", "Persian"),
}
FALLBACK_COLOURS = ["#469990", "#800000", "#808000"]


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def two_part_prefix(name: Column) -> Column:
    """First two underscore parts, or the whole name when there is only one."""
    return F.substring_index(name, "_", 2)


def parser_code(path: Column) -> Column:
    """Parser language by case-insensitive two-part prefix; null when unknown."""
    codes = literal_map({k.lower(): v for k, v in PARSER_CODES.items()})
    name = stem(path)
    return F.when(F.instr(name, "_") > 0, codes[F.lower(two_part_prefix(name))])


def source_tag(path: Column) -> Column:
    """File stem without the parse suffix; identifies a source inside a merged group."""
    return F.replace(stem(path), F.lit("_parsed"), F.lit(""))


def merge_group(path: Column) -> Column:
    """Analysis group of a file: script variants share one, others stand alone."""
    prefix = two_part_prefix(source_tag(path))
    return F.coalesce(literal_map(MERGE_GROUPS)[prefix], prefix)


def display_language(path: Column) -> Column:
    return literal_map(DISPLAY_LANGUAGES)[two_part_prefix(stem(path))]


def task_cap(lang: Column) -> Column:
    return F.coalesce(literal_map({k: str(v) for k, v in TASK_CAPS.items()})[lang].cast("int"), F.lit(TASK_CAP))


def language_styles(langs: list[str]) -> list[tuple[str, str, str]]:
    """(language, colour, name) in the given order; unknown languages rotate the fallback colours."""
    out, used = [], 0
    for lang in langs:
        if lang in LANGUAGE_STYLES:
            colour, name = LANGUAGE_STYLES[lang]
        else:
            colour, name = FALLBACK_COLOURS[used % len(FALLBACK_COLOURS)], lang
            used += 1
        out.append((lang, colour, name))
    return out
