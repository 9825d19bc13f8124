"""The dependency parser: an outside model behind a small interface.

A factory builds one parser per language and Python worker. A parser takes a
text and returns sentences: dicts with ``text`` and ``tokens``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registrum.functions import text as T
from registrum.schemas import PARSE, PARSED_SEGMENT

Parser = Callable[[str], list[dict]]

# The fields of a token.
TOKEN_FIELDS = ["id", "text", "lemma", "upos", "xpos", "feats", "head", "deprel", "start_char", "end_char"]


def as_parse(sentences: list[dict]) -> dict:
    """Parser output in storage form; an empty feature string is null."""
    return {
        "sentences": [
            {
                "text": s.get("text"),
                "tokens": [{**{f: t.get(f) for f in TOKEN_FIELDS}, "feats": t.get("feats") or None} for t in s["tokens"]],
            }
            for s in sentences
        ]
    }


def parser_udf(factory: Callable[[str], Parser]) -> Callable[[Column, Column], Column]:
    """Column function from (language, array of texts) to an array of parses.

    Blank texts and texts the parser fails on have no parse. Only language and
    texts travel to Python.
    """

    def parses(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        parsers: dict[str, Parser] = {}

        def one(lang: str, text: str | None) -> dict | None:
            if not text or not text.strip():
                return None
            try:
                return as_parse(parsers[lang](text))
            except Exception:
                return None

        for langs, texts in batches:
            out = []
            for lang, row in zip(langs, texts):
                if lang not in parsers:
                    parsers[lang] = factory(lang)
                out.append([one(lang, t) for t in row])
            yield pd.Series(out, dtype=object)

    parses.__annotations__ = {
        "batches": Iterator[tuple[pd.Series, pd.Series]],
        "return": Iterator[pd.Series],
    }
    return F.pandas_udf(parses, f"array<{PARSE}>").asNondeterministic()


def parse_segments(mapped: DataFrame, lang: Column, parser: Callable[[Column, Column], Column]) -> DataFrame:
    """Segments with their parses; documents keep their rows, whatever fails."""
    texts = F.transform("segments", lambda s: s["text"])
    with_parse = mapped.withColumn("_parses", parser(lang, texts))
    joined = F.transform(
        F.arrays_zip("segments", "_parses"),
        lambda p: F.struct(
            p["segments"]["label"].alias("label"),
            p["segments"]["text"].alias("text"),
            p["_parses"].alias("parse"),
            F.lit(None).cast("string").alias("_source"),
        ),
    )
    return with_parse.withColumn("segments", joined.cast(f"array<{PARSED_SEGMENT}>")).drop("_parses")
