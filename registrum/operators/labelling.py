"""Labelling the lines of documents through an annotator.

A document row carries its prompts as an array, gets the answers as an array
beside them, and merges both into labels without leaving the row. The whole
stage is a chain of narrow steps around two calls of the annotator: one for all
chunks, one for what the first answers left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registrum.functions import annotation as A
from registrum.functions import text as T
from registrum.functions.arrays import bind, last, lookup
from registrum.operators.lines import PAIR, markdown_of
from registrum.schemas import ANNOTATION, ANNOTATIONS, LINE, SECTIONS
from registrum.session import built_once, materialise

# Lines per request, context lines around them, opening lines, characters per line.
CHUNK_LINES = 15
CONTEXT_LINES = 10
OPENING_LINES = 5
LINE_CHARS = 500

# Headings and marks of a request.
OPENING_TITLE = "[DOCUMENT OPENING — for context only, do not classify]"
CONTEXT_TITLE = "[CONTEXT — do not classify]"
TARGET_TITLE = "[CLASSIFY THESE LINES]"
STRUCTURAL_MARK = "  {structural — do not classify}"

_CALL = "struct<section:string,begin:int,end:int,prompt:string>"


def _shown(line: Column) -> Column:
    return F.concat(F.lit("["), line["num"].cast("string"), F.lit("] "), T.truncate(line["text"], LINE_CHARS))


def opening(lines: Column, n: int = OPENING_LINES) -> Column:
    """The first non-structural, non-blank lines of a section."""
    return F.slice(F.filter(lines, lambda l: ~T.is_structural(l["text"]) & ~T.is_blank(l["text"])), 1, n)


def _block(title: str, rendered: Column) -> Column:
    """A titled block after an empty line, or nothing when it has no lines."""
    return F.when(F.size(rendered) > 0, F.concat(F.array(F.lit(""), F.lit(title)), rendered)).otherwise(
        F.array().cast("array<string>")
    )


def prompt_text(url: Column, section: str, lines: Column, first_lines: Column, begin: Column, end: Column) -> Column:
    """Request for lines ``[begin, end)``: opening, context before, target lines, context after."""
    target = F.slice(lines, begin + 1, end - begin)
    before = F.slice(lines, F.greatest(begin + 1 - CONTEXT_LINES, F.lit(1)), F.least(begin, F.lit(CONTEXT_LINES)))
    after = F.slice(lines, end + 1, F.lit(CONTEXT_LINES))

    def build(p: Column) -> Column:
        numbers = F.transform(p["target"], lambda l: l["num"])
        elsewhere = F.filter(first_lines, lambda l: ~F.array_contains(numbers, l["num"]))
        marked = F.transform(
            p["target"],
            lambda l: F.concat(
                _shown(l), F.when(T.is_structural(l["text"]), STRUCTURAL_MARK).otherwise("")
            ),
        )
        return F.array_join(
            F.concat(
                F.array(F.concat(F.lit("URL: "), F.coalesce(url, F.lit(""))), F.lit(f"Section: {section}")),
                _block(OPENING_TITLE, F.transform(elsewhere, _shown)),
                _block(CONTEXT_TITLE, F.transform(p["before"], _shown)),
                F.array(F.lit(""), F.lit(TARGET_TITLE)),
                marked,
                _block(CONTEXT_TITLE, F.transform(p["after"], _shown)),
            ),
            "\n",
        )

    return bind(F.struct(target.alias("target"), before.alias("before"), after.alias("after")), build)


def section_calls(section: str, lines: Column, url: Column) -> Column:
    """One call per chunk with a line to classify; chunks of structural lines need none."""

    def calls(p: Column) -> Column:
        size = F.size(p["lines"])
        begins = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(CHUNK_LINES))).otherwise(
            F.array().cast("array<int>")
        )
        needed = F.filter(
            begins,
            lambda b: F.exists(F.slice(p["lines"], b + 1, F.lit(CHUNK_LINES)), lambda l: ~T.is_structural(l["text"])),
        )
        return F.transform(
            needed,
            lambda b: bind(
                F.least(b + CHUNK_LINES, size),
                lambda e: F.struct(
                    F.lit(section).alias("section"),
                    b.alias("begin"),
                    e.alias("end"),
                    prompt_text(url, section, p["lines"], p["opening"], b, e).alias("prompt"),
                ),
            ),
        ).cast(f"array<{_CALL}>")

    return bind(lines, lambda ls: bind(F.struct(ls.alias("lines"), opening(ls).alias("opening")), calls))


def plan_calls(docs: DataFrame, keys: list[str]) -> DataFrame:
    """All first calls of each document, one row per call."""
    numbered = docs.select(*keys, "u", *[_numbered(s).alias(name) for s, name in _LINES.items()])
    return numbered.select(*keys, F.inline(_first_calls()))


def _of(section: str, calls: Column) -> Column:
    return F.filter(calls, lambda c: c["section"] == section)


def missing_lines(target: Column, answered: Column) -> Column:
    """Line numbers to classify that the answer does not name."""
    expected = F.transform(F.filter(target, lambda l: ~T.is_structural(l["text"])), lambda l: l["num"])
    return F.array_except(expected, F.transform(answered, lambda a: a["line"]))


def _recalls(section: str, decoded: Column, lines: Column, url: Column) -> Column:
    """Second calls: one per incomplete chunk, over the span from its first to its last missing line."""

    def recall(p: Column) -> Column:
        def spans(c: Column) -> Column:
            target = F.slice(p["lines"], c["begin"] + 1, c["end"] - c["begin"])
            return bind(
                missing_lines(target, c["answer"]["items"]),
                lambda miss: F.filter(
                    F.transform(target, lambda l, i: F.when(F.array_contains(miss, l["num"]), c["begin"] + i)),
                    lambda i: i.isNotNull(),
                ),
            )

        gaps = F.filter(
            F.transform(
                F.filter(_of(section, decoded), lambda c: c["answer"]["status"] == "ok"),
                lambda c: spans(c),
            ),
            lambda g: F.size(g) > 0,
        )
        return F.transform(
            gaps,
            lambda g: bind(
                F.struct(F.get(g, F.lit(0)).alias("b"), (last(g) + 1).alias("e")),
                lambda r: F.struct(
                    F.lit(section).alias("section"),
                    r["b"].alias("begin"),
                    r["e"].alias("end"),
                    prompt_text(url, section, p["lines"], p["opening"], r["b"], r["e"]).alias("prompt"),
                ),
            ),
        ).cast(f"array<{_CALL}>")

    return bind(F.struct(lines.alias("lines"), opening(lines).alias("opening")), recall)


def _decode(calls: Column, answers: Column) -> Column:
    return F.zip_with(
        calls,
        answers,
        lambda c, a: F.struct(
            c["section"].alias("section"),
            c["begin"].alias("begin"),
            c["end"].alias("end"),
            A.decode_response(a).alias("answer"),
        ),
    )


def _section_labels(section: str, lines: Column, first: Column, second: Column) -> Column:
    """Final labels of a section; empty when a call failed or an answer had another shape.

    Answers apply chunk by chunk, each chunk's second answer after its first,
    and the last one naming a line counts. A chunk without a usable answer
    cannot be rated as a whole.
    """

    def of_chunk(c: Column) -> Column:
        own = F.when(
            c["answer"]["status"] == "ok", c["answer"]["items"]
        ).otherwise(
            F.transform(
                F.slice(lines, c["begin"] + 1, c["end"] - c["begin"]), lambda l: A.cannot_rate(l["num"])
            )
        )
        again = F.flatten(
            F.transform(
                F.filter(
                    second,
                    lambda d: (d["section"] == section)
                    & (d["begin"] >= c["begin"])
                    & (d["end"] <= c["end"])
                    & (d["answer"]["status"] == "ok"),
                ),
                lambda d: d["answer"]["items"],
            )
        )
        return F.concat(own, again)

    mine = _of(section, first)
    failed = F.exists(mine, lambda c: c["answer"]["status"].isNull() | (c["answer"]["status"] == "broken"))
    labelled = lookup(
        lines,
        lambda l: l["num"],
        F.flatten(F.transform(mine, of_chunk)),
        lambda a: a["line"],
        lambda l, a: F.when(T.is_structural(l["text"]), A.structural(l["num"]))
        .when(
            a.isNotNull(),
            A.validate(
                A.make_annotation(
                    l["num"],
                    A.demote_transcribed(a["mode_medium"], F.lit(section)),
                    a["mode_turn"],
                    a["field_activity"],
                    a["tenor_formality"],
                )
            ),
        )
        .otherwise(A.cannot_rate(l["num"])),
        ANNOTATION,
        LINE,
    )
    return F.when(failed, F.array().cast(ANNOTATIONS)).otherwise(labelled)


# The columns a document carries through the stage.
_LINES = {s: f"_{s}_lines" for s in SECTIONS}


@built_once
def _numbered(section: str) -> Column:
    return T.parse_numbered(markdown_of(section))


@built_once
def _first_calls() -> Column:
    return F.concat(*[section_calls(s, F.col(_LINES[s]), F.col("u")) for s in SECTIONS])


@built_once
def _second_calls() -> Column:
    return F.concat(*[_recalls(s, F.col("_first"), F.col(_LINES[s]), F.col("u")) for s in SECTIONS])


@built_once
def _decoded(calls: str, answers: str) -> Column:
    return _decode(F.col(calls), F.col(answers))


@built_once
def _labels(section: str) -> Column:
    return _section_labels(section, F.col(_LINES[section]), F.col("_first"), F.col("_second"))


@built_once
def _prompts(calls: str) -> Column:
    return F.transform(calls, lambda c: c["prompt"])


def annotate(docs: DataFrame, annotator: Callable[[Column], Column], path: str | None = None) -> DataFrame:
    """Add the annotation pair to documents.

    ``annotator`` is a column function from prompts to answers, or a queue with a journal
    (:class:`registrum.sources.journal.Queue`), which keeps every single answer. First answers are written to shared storage (``path``, or the cluster's
    checkpoint folder) before the second round, so nothing is asked twice.
    """

    def ask(df: DataFrame, calls: str, output: str, number: int) -> DataFrame:
        queued = getattr(annotator, "answers", None)
        return queued(df, calls, output, number) if queued else df.withColumn(output, annotator(_prompts(calls)))

    columns = docs.columns
    asked = docs.select(*columns, *[_numbered(s).alias(name) for s, name in _LINES.items()])
    asked = asked.withColumn("_calls", _first_calls())
    answered = ask(asked, "_calls", "_answers", 1)
    first = materialise(answered, path and f"{path}/first").withColumn("_first", _decoded("_calls", "_answers"))
    again = first.withColumn("_recalls", _second_calls())
    again = ask(again, "_recalls", "_reanswers", 2)
    second = materialise(again, path and f"{path}/second").withColumn("_second", _decoded("_recalls", "_reanswers"))
    pair = F.struct(*[_labels(s).alias(s) for s in SECTIONS])
    kept = [c for c in columns if c != PAIR]
    return second.select(*kept, pair.alias(PAIR))


def failed_documents(docs: DataFrame) -> DataFrame:
    """Documents to label again."""
    return docs.where(A.has_errors(F.col(PAIR), {s: markdown_of(s) for s in SECTIONS}))


def replace_failed(output: DataFrame, redone: DataFrame, key: str) -> DataFrame:
    """Output with the annotations of redone documents in place; everything else as it was."""
    new = redone.select(key, F.col(PAIR).alias("_new"))
    merged = output.join(new, key, "left")
    columns = [
        F.coalesce("_new", PAIR).alias(PAIR) if c == PAIR else F.col(c) for c in output.columns
    ]
    return merged.select(*columns)


def retry(inputs: DataFrame, output: DataFrame, annotator: Callable[[Column], Column], key: str,
          path: str | None = None) -> DataFrame:
    """Label the failed documents of ``output`` again, from their input text, and put them back.

    A section whose second attempt fails too keeps what it had. Only the keys
    of failed documents meet the input table.
    """
    failed = failed_documents(output).select(key, F.col(PAIR).alias("_old"))
    redo = inputs.join(failed, key)
    done = annotate(redo, annotator, path)
    empty = F.array().cast(ANNOTATIONS)
    kept = F.struct(
        *[
            F.when(F.size(F.col(PAIR)[s]) > 0, F.col(PAIR)[s])
            .otherwise(F.coalesce(F.col("_old")[s], empty))
            .alias(s)
            for s in SECTIONS
        ]
    )
    return replace_failed(output, done.select(key, kept.alias(PAIR)), key)
