"""Expressions over one line's annotation: defaults, repair, registers, keys, decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from registrum.functions.arrays import bind
from registrum.functions.names import literal_map
from registrum.schemas import ACTIVITY, ANNOTATION, FACETS, FORMALITY, MEDIUM, TURN

# Activity to register, short names, used when scoring annotators.
REGISTER_SHORT = {
    "recounting": "Narrative",
    "explaining": "Info. description/explanation",
    "evaluating": "Opinion",
    "promoting": "Info. persuasion",
    "directing": "How-to/instruct.",
    "creating": "Lyrical",
}
# Activity to register, long names, used when building segments.
REGISTER_LONG = {
    "recounting": "Narrative",
    "explaining": "Informational Description",
    "evaluating": "Opinion",
    "promoting": "Informational Persuasion",
    "directing": "How-to or Instructional",
    "creating": "Lyrical",
}
CANNOT_RATE = "Cannot rate"


def make_annotation(line: Column, medium, turn, activity, formality, structural=None) -> Column:
    def col(value) -> Column:
        return value if isinstance(value, Column) else F.lit(value).cast("string")

    flag = structural if isinstance(structural, Column) else F.lit(structural).cast("boolean")
    return F.struct(
        line.cast("int").alias("line"),
        col(medium).alias("mode_medium"),
        col(turn).alias("mode_turn"),
        col(activity).alias("field_activity"),
        col(formality).alias("tenor_formality"),
        flag.alias("is_structural"),
    ).cast(ANNOTATION)


def cannot_rate(line: Column) -> Column:
    """Fallback for a line nobody could label."""
    return make_annotation(line, "cannot_rate", None, None, None)


def structural(line: Column) -> Column:
    """Local label of headings, tables and code: unrateable, flagged."""
    return make_annotation(line, "cannot_rate", None, None, None, True)


def demote_transcribed(medium: Column, section: Column) -> Column:
    """Comments are written, whatever the annotator says."""
    return F.when((section == "comments") & (medium == "transcribed"), F.lit("written")).otherwise(medium)


def validate(ann: Column) -> Column:
    """Repair an annotation.

    An unknown medium makes the line unrateable, and an unrateable line has no
    other facet. On a rateable line a missing or unknown facet takes its default.
    """
    medium = F.when(ann["mode_medium"].isin(MEDIUM), ann["mode_medium"]).otherwise("cannot_rate")
    rateable = medium != "cannot_rate"

    def facet(name: str, allowed: list[str], default: str) -> Column:
        value = F.when(ann[name].isin(allowed), ann[name]).otherwise(default)
        return F.when(rateable, value)

    return make_annotation(
        ann["line"],
        medium,
        facet("mode_turn", TURN, "monologic"),
        facet("field_activity", ACTIVITY, "explaining"),
        facet("tenor_formality", FORMALITY, "formal"),
        ann["is_structural"],
    )


def is_valid(ann: Column) -> Column:
    """True when repair would change nothing."""
    return bind(validate(ann), lambda fixed: fixed.eqNullSafe(ann))


def _register(medium: Column, turn: Column, activity: Column, names: dict[str, str]) -> Column:
    return (
        F.when(medium == "cannot_rate", CANNOT_RATE)
        .when(medium == "transcribed", "Spoken")
        .when(turn == "dialogic", "Interactive Discussion")
        .otherwise(literal_map(names)[activity])
    )


def register_for_scoring(medium: Column, turn: Column, activity: Column) -> Column:
    """Register with short names; null when the facets do not determine one."""
    return _register(medium, turn, activity, REGISTER_SHORT)


def register_for_segments(medium: Column, turn: Column, activity: Column) -> Column:
    """Register with long names; undetermined lines cannot be rated."""
    return F.coalesce(_register(medium, turn, activity, REGISTER_LONG), F.lit(CANNOT_RATE))


def _medium_activity(ann: Column) -> Column:
    """Label pair; a null medium is spelt as the report writer spells it."""
    activity = F.when(ann["mode_medium"] == "cannot_rate", "_").otherwise(
        F.coalesce(ann["field_activity"], F.lit("none"))
    )
    return F.concat_ws("|", F.coalesce(ann["mode_medium"], F.lit("unknown")), activity)


def label_key(ann: Column) -> Column:
    """Key of the label distribution."""
    return F.when(ann.isNull(), "no_ann").otherwise(_medium_activity(ann))


def stratum_key(ann: Column) -> Column:
    """Key of the sampling strata; differs from the distribution key on unlabelled lines."""
    return F.when(ann.isNull(), "no_ann|none").otherwise(_medium_activity(ann))


def any_facet_is(ann: Column, value: str) -> Column:
    """Some facet has this label; false for an unlabelled line."""
    hit = F.lit(False)
    for facet in FACETS:
        hit = hit | ann[facet].eqNullSafe(F.lit(value))
    return ann.isNotNull() & hit


def is_reviewable(ann: Column, value: str | None = None) -> Column:
    """Lines worth showing: those with the label asked for, or all rated ones."""
    if value is not None:
        return any_facet_is(ann, value)
    medium = ann["mode_medium"]
    return ann.isNotNull() & medium.isNotNull() & ~F.coalesce(medium, F.lit("")).isin("cannot_rate", "structural")


def describe(ann: Column) -> Column:
    """One-line summary without colours."""
    rated = F.concat_ws(
        " | ",
        F.coalesce(ann["field_activity"], F.lit("None")),
        F.coalesce(ann["mode_medium"], F.lit("None")),
        F.coalesce(ann["mode_turn"], F.lit("None")),
        F.concat(
            F.coalesce(ann["tenor_formality"], F.lit("None")),
            F.when(F.coalesce(ann["is_structural"], F.lit(False)), " [structural]").otherwise(""),
        ),
    )
    return (
        F.when(ann.isNull(), "(no annotation)")
        .when(ann["mode_medium"].isin("cannot_rate", "structural"), "cannot_rate")
        .otherwise(rated)
    )


def has_errors(pair: Column, markdown: dict[str, Column]) -> Column:
    """A document to label again: no labels at all, or a non-blank section without any."""
    from registrum.functions.text import is_blank

    failed = pair.isNull()
    for section, text in markdown.items():
        failed = failed | (~is_blank(text) & (F.coalesce(F.size(pair[section]), F.lit(0)) <= 0))
    return F.coalesce(failed, F.lit(True))


_ITEM = "struct<line:double,mode_medium:string,mode_turn:string,field_activity:string,tenor_formality:string>"


def decode_response(raw: Column) -> Column:
    """Annotator's text to ``struct<status, items array<annotation>>``.

    Code fences and thinking blocks go; the first ``[`` starts the array. A
    valid array is taken as it is, a cut-off one up to its last closed object.
    ``status`` is ``ok``, ``unparsed`` (nothing usable), or ``broken`` (valid
    JSON of another shape, which fails the whole section). No text at all, the
    mark of a failed call, has no status.
    """
    space = r"(?U:[\s\x1c-\x1f])*"
    text = F.regexp_replace(raw, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    text = F.regexp_replace(text, "^```(?:json)?" + space, "")
    text = F.regexp_replace(text, space + "```$", "")
    text = F.regexp_replace(text, "(?s)<think>.*?</think>", "")
    text = F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")

    def as_items(json: Column) -> Column:
        # The reader ignores what follows a value. A closing mark behind the array
        # is only found when nothing else stands between.
        closed = F.from_json(F.concat(F.lit('{"a":'), json, F.lit(',"z":1}')), "a array<string>, z int")
        return bind(closed, lambda c: F.when(c["z"] == 1, c["a"]))

    def decode(p: Column) -> Column:
        body = p["text"]
        start = F.instr(body, "[")
        candidate = F.substring(body, start, F.length(body))
        closed = F.regexp_extract(candidate, r"(?s)^(.*\})[^}]*$", 1)
        salvaged = F.when(closed != "", as_items(F.concat(closed, F.lit("]"))))
        other_json = (start > 1) & as_items(F.concat(F.lit("["), body, F.lit("]"))).isNotNull()

        def build(q: Column) -> Column:
            items = F.coalesce(q["whole"], F.when(~q["other"], q["salvaged"]))
            objects = F.forall(items, lambda x: x.startswith("{"))
            status = (
                F.when(body.isNull(), F.lit(None))
                .when(start == 0, "unparsed")
                .when(q["whole"].isNull() & q["other"], "broken")
                .when(items.isNull(), "unparsed")
                .when(~objects, "broken")
                .otherwise("ok")
            )
            parsed = F.transform(
                F.when(objects, items),
                lambda x: bind(
                    F.from_json(x, _ITEM),
                    lambda a: make_annotation(
                        F.when(a["line"] == F.floor(a["line"]), a["line"]),
                        a["mode_medium"],
                        a["mode_turn"],
                        a["field_activity"],
                        a["tenor_formality"],
                    ),
                ),
            )
            return F.struct(status.alias("status"), parsed.alias("items"))

        return bind(
            F.struct(
                F.when(start > 0, as_items(candidate)).alias("whole"),
                salvaged.alias("salvaged"),
                F.coalesce(other_json, F.lit(False)).alias("other"),
            ),
            build,
        )

    return bind(F.struct(text.alias("text")), decode)
