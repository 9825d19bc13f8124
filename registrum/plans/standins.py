"""Inputs derived from the given tables.

The tables hold plain text only. These frames give it the shapes the stages
work on: annotated documents (two raters), raw XML documents, annotator
responses and dependency parses. Every value is arithmetic over document
number, line position and text length, so an oracle can repeat it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from registrum.functions import text as T
from registrum.functions.parses import counted_from, lowered, owners, places
from registrum.session import spread
from registrum.sources.annotator import Provider
from registrum.schemas import ANNOTATIONS, PARSED_SEGMENT, SECTION_PAIR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their non-empty lines; the first three quarters are the main text."""
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id",
        "lang",
        "source",
        F.expr("filter(transform(split(text, '\n'), x -> trim(x)), x -> x <> '')").alias("raw_lines"),
    )


_LINE_TEXT = """CASE WHEN (doc_id + k) % 11 = 0 THEN concat('# ', x)
 WHEN (doc_id + k) % 13 = 0 THEN concat('TABLE: R: ', x)
 WHEN (doc_id + k) % 17 = 0 THEN concat('CODE: ', x)
 WHEN (doc_id + k) % 7 = 0 THEN concat('> ', x) ELSE x END""".replace("k)", "i + 1)")

_BUMP = "IF({r} = 2 AND (doc_id + i + 1) % 5 = 0, 1, 0)"


def _facets(rater: int, bad: bool) -> str:
    """Array of annotations, one per line, as SQL over (x, i) = (line text, 0-based position)."""
    no, bump = "(i + 1)", _BUMP.format(r=rater)
    h = f"((doc_id * 31 + ({no} - {no} % 2) * 17 + {bump} * 2) % 20)"
    activity = (
        f"CASE (doc_id * 7 + ({no} - {no} % 3) + {bump}) % 6 WHEN 0 THEN 'recounting' WHEN 1 THEN 'explaining' "
        "WHEN 2 THEN 'directing' WHEN 3 THEN 'evaluating' WHEN 4 THEN 'promoting' ELSE 'creating' END"
    )
    medium = f"CASE WHEN {h} < 3 THEN 'cannot_rate' WHEN {h} < 5 THEN 'transcribed' ELSE 'written' END"
    turn = f"CASE WHEN {h} < 3 THEN NULL WHEN (doc_id * 13 + {no}) % 7 < 2 THEN 'dialogic' ELSE 'monologic' END"
    activity = f"CASE WHEN {h} < 3 THEN NULL ELSE {activity} END"
    formality = (
        f"CASE WHEN {h} < 3 THEN NULL WHEN (doc_id + {no} * 3 + {bump}) % 4 = 0 THEN 'informal' ELSE 'formal' END"
    )
    if bad:
        medium = f"CASE WHEN (doc_id * 3 + {no}) % 23 = 0 THEN 'spoken' ELSE {medium} END"
        turn = f"CASE WHEN (doc_id + {no}) % 9 = 0 THEN 'both' WHEN (doc_id + {no}) % 9 = 1 THEN NULL ELSE {turn} END"
        activity = f"CASE WHEN (doc_id + {no}) % 8 = 0 THEN 'news' WHEN (doc_id + {no}) % 8 = 1 THEN NULL ELSE {activity} END"
        formality = f"CASE WHEN (doc_id + {no}) % 6 = 0 THEN 'casual' WHEN (doc_id + {no}) % 6 = 1 THEN NULL ELSE {formality} END"
    return (
        "transform(raw_lines, (x, i) -> named_struct('line', i + 1, "
        f"'mode_medium', {medium}, 'mode_turn', {turn}, 'field_activity', {activity}, "
        f"'tenor_formality', {formality}, 'is_structural', CAST(NULL AS BOOLEAN)))"
    )


def url_expr() -> str:
    """Every third document repeats the address before it."""
    return "concat('https://example.org/', CAST(doc_id - (doc_id % 3) % 2 AS STRING))"


def annotated(spark: SparkSession, sf_dir: str, rater: int = 1, bad: bool = False) -> DataFrame:
    """Annotated documents of one rater, in the layout of the labelling stage's output."""
    split_at = "((3 * size(raw_lines) + 3) div 4)"
    docs = (
        documents(spark, sf_dir)
        .withColumn("texts", F.expr(f"transform(raw_lines, (x, i) -> {_LINE_TEXT})"))
        .withColumn("anns", F.expr(_facets(rater, bad)).cast(ANNOTATIONS))
    )
    empty_url, failed = ("20", "17") if rater == 1 else ("25", "19")
    return docs.select(
        "doc_id",
        "lang",
        "source",
        F.expr(f"CASE WHEN doc_id % {empty_url} = 0 THEN '' ELSE {url_expr()} END").alias("u"),
        T.number_lines(F.expr(f"slice(texts, 1, {split_at})")).alias("markdown_main"),
        T.number_lines(F.expr(f"slice(texts, {split_at} + 1, size(texts))")).alias("markdown_comments"),
        F.expr(
            f"named_struct('main', slice(anns, 1, {split_at}), 'comments', "
            f"transform(slice(anns, {split_at} + 1, size(anns)), a -> named_struct('line', a.line - {split_at}, "
            "'mode_medium', a.mode_medium, 'mode_turn', a.mode_turn, 'field_activity', a.field_activity, "
            "'tenor_formality', a.tenor_formality, 'is_structural', a.is_structural)))"
        )
        .cast(SECTION_PAIR)
        .alias("llm_register_annotation"),
        F.expr(f"doc_id % {failed} = 0").alias("classification_failed"),
    )


def raw_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw web documents: each line becomes a block; some documents are cut off and do not parse."""
    esc = "replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    block = f"""CASE WHEN (doc_id + i + 1) % 11 = 0 THEN concat('<h2 rend="x">', {esc}, '</h2>')
 WHEN (doc_id + i + 1) % 13 = 0 THEN concat('<table><row><cell role="head">', {esc}, '</cell><cell> k </cell></row><row><cell>', {esc}, '</cell><cell/></row></table>')
 WHEN (doc_id + i + 1) % 17 = 0 THEN concat('<code>', {esc}, '</code>')
 WHEN (doc_id + i + 1) % 7 = 0 THEN concat('<quote><p>', {esc}, '</p></quote>')
 WHEN (doc_id + i + 1) % 5 = 0 THEN concat('<list><item>', {esc}, '</item><item>b</item><item> </item></list>')
 WHEN (doc_id + i + 1) % 19 = 0 THEN concat('<p><hi rend="#b">', {esc}, '</hi></p>')
 WHEN (doc_id + i + 1) % 23 = 0 THEN concat('<graphic/><p>  ', {esc}, '\t<code> f(x) </code><ref>end</ref> </p>')
 ELSE concat('<p>', {esc}, '</p>') END"""
    split_at = "((3 * size(raw_lines) + 3) div 4)"
    return (
        documents(spark, sf_dir)
        .withColumn("blocks", F.expr(f"transform(raw_lines, (x, i) -> {block})"))
        .select(
            "doc_id",
            F.expr(url_expr()).alias("u"),
            F.expr(
                "concat('<doc fingerprint=\"d', doc_id, '\" id=\"9\">\n<main>', "
                f"array_join(slice(blocks, 1, {split_at}), '\n'), '</main><comments>', "
                f"array_join(slice(blocks, {split_at} + 1, size(blocks)), ' '), '</comments>', "
                "CASE WHEN doc_id % 10 = 7 THEN '' ELSE '</doc>' END)"
            ).alias("xml"),
        )
    )


# Documents that are parsed at a time.
_PARSED_ROWS = 64
_UPOS = pa.array(["NOUN", "VERB", "DET", "ADP", "ADJ", "NOUN", "ADV", None, "PUNCT"], pa.string())
_FEATS = pa.array(["Case=Nom|Number=Sing", "Mood=Ind|Number=Plur|Tense=Past", None, "Foreign|Case=Acc"], pa.string())
_DEPREL = pa.array(["nsubj", "obj", "nmod:poss", "", "advmod", "root", "punct"], pa.string())


def _split(texts: pa.Array, mark: str) -> tuple[np.ndarray, pa.Array]:
    """Parts between marks, blanks trimmed, without empty ones: the number of the text each is of, and the parts."""
    cut = pc.split_pattern(texts, mark)
    owner, flat = owners(cut), cut.flatten()
    if mark != " ":
        flat = pc.ascii_trim(flat, " ")
    there = pc.greater(pc.binary_length(flat), 0)
    if pc.all(there).as_py() is not False:
        return owner, flat
    return owner[there.to_numpy(zero_copy_only=False)], flat.filter(there)


def _tokens(sentences: pa.Array) -> pa.ListArray:
    """Tokens of sentences; their strings are numbers into the distinct ones."""
    owner, words = _split(pc.binary_join_element_wise(sentences, " .", ""), " ")
    at = places(owner, len(sentences))
    words = words.dictionary_encode()
    names, word = words.dictionary, words.indices.to_numpy(zero_copy_only=False)
    length_of = pc.utf8_length(names).to_numpy(zero_copy_only=False)
    stop = pc.equal(names, ".").to_numpy(zero_copy_only=False)[word]
    length = length_of[word]
    lemmas = pc.if_else(pa.array(length_of % 8 == 0), pa.scalar(None, names.type), lowered(names))

    def tags(numbers: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.DictionaryArray.from_arrays(pa.array(numbers, pa.int32()), values)

    nothing = {c: pa.nulls(len(words), t) for c, t in (("xpos", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32()))}
    fields = {
        "id": pa.array(at + 1, pa.int32()),
        "text": words,
        "lemma": pa.DictionaryArray.from_arrays(words.indices, lemmas),
        "upos": tags(np.where(stop, 8, (length + (at & 1)) & 7), _UPOS),
        "xpos": nothing["xpos"],
        "feats": tags(np.where(stop, 2, length & 3), _FEATS),
        "head": pa.array(at, pa.int32()),
        "deprel": tags(np.where(at == 0, 5, np.where(stop, 6, (length + at) % 5)), _DEPREL),
        "start_char": nothing["start_char"],
        "end_char": nothing["end_char"],
    }
    ends = np.cumsum(np.bincount(owner, minlength=len(sentences)))
    return pa.ListArray.from_arrays(counted_from(ends), pa.StructArray.from_arrays(fields.values(), names=list(fields)))


def parses_of(texts: pa.Array) -> pa.StructArray:
    """Stand-in parses of texts: sentences end at full stops, words at blanks."""
    owner, sentences = _split(texts, ".")
    rows = pa.StructArray.from_arrays([sentences, _tokens(sentences)], names=["text", "tokens"])
    ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(counted_from(ends), rows)], names=["sentences"])


def parsed(mapped: DataFrame, keys: list[str]) -> DataFrame:
    """Segments with stand-in parses, in the parser stage's layout."""
    rows = mapped.select(*keys, "segments")
    schema = StructType(rows.schema.fields[:-1] + StructType.fromDDL(f"segments array<{PARSED_SEGMENT}>").fields)
    plain = to_arrow_type(schema["segments"].dataType.elementType["parse"].dataType)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _PARSED_ROWS):
                part = batch.slice(start, _PARSED_ROWS)
                found = part.column("segments")
                label, text = (pc.struct_field(found.flatten(), f) for f in ("label", "text"))
                ends = np.cumsum(np.bincount(owners(found), minlength=len(found)))
                segments = pa.StructArray.from_arrays(
                    [label, text, parses_of(text).cast(plain), pa.nulls(len(text), pa.string())], names=["label", "text", "parse", "_source"]
                )
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.ListArray.from_arrays(counted_from(ends), segments)], names=part.schema.names
                )

    return rows.mapInArrow(parse, schema)


def embedding_columns(spark: SparkSession, sf_dir: str, dims: int = 64) -> DataFrame:
    """Embedding vectors as a wide feature table with register and language columns."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.concat(F.lit("reg"), F.col("label")).alias("label"),
        F.concat(F.lit("lang"), F.col("vec_id") % 4).alias("lang"),
        *[F.col("embedding")[i].cast("double").alias(f"e{i:02d}") for i in range(dims)],
    )


def rated_lines(spark: SparkSession, sf_dir: str, bad: bool = False) -> DataFrame:
    """Lines with both raters' labels: rater 2 as the human, rater 1 as the model."""
    def labels(ann: str) -> str:
        return (
            f"named_struct('mode_medium', {ann}.mode_medium, 'mode_turn', {ann}.mode_turn, "
            f"'field_activity', {ann}.field_activity, 'tenor_formality', {ann}.tenor_formality)"
        )

    docs = documents(spark, sf_dir).select(
        "doc_id", "lang", F.expr(_facets(2, bad)).alias("human"), F.expr(_facets(1, bad)).alias("llm")
    )
    return docs.select("doc_id", "lang", F.inline(F.arrays_zip("human", "llm"))).select(
        "doc_id",
        "lang",
        F.col("human.line").alias("line_no"),
        F.expr(labels("human")).alias("human_labels"),
        F.expr(labels("llm")).alias("llm_labels"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotator answers as raw text, one per document: fenced, chatty, cut off, wordless or of another shape."""
    items = F.expr(
        "transform(filter(llm_register_annotation.main, a -> (doc_id + a.line) % 9 <> 4), a -> named_struct("
        "'line', a.line, 'mode_medium', a.mode_medium, 'mode_turn', a.mode_turn, "
        "'field_activity', a.field_activity, 'tenor_formality', a.tenor_formality))"
    )
    text = F.to_json(items, {"ignoreNullFields": "false"})
    raw = (
        F.when(F.expr("doc_id % 10 = 0"), F.concat(F.lit("```json\n"), text, F.lit("\n```")))
        .when(F.expr("doc_id % 10 = 1"), F.concat(F.lit("Sure: "), text, F.lit(" hope that helps")))
        .when(F.expr("doc_id % 10 = 2"), F.expr("substring(t, 1, length(t) - 3)"))
        .when(F.expr("doc_id % 10 = 3"), F.concat(F.lit("<think>[x]\nhm</think>\n"), text))
        .when(F.expr("doc_id % 10 = 4"), F.lit("I cannot do that."))
        .when(F.expr("doc_id % 10 = 5"), F.concat(F.lit('{"items":'), text, F.lit("}")))
        .when(F.expr("doc_id % 10 = 6"), F.lit("[1, 2]"))
        .when(F.expr("doc_id % 10 = 7"), F.lit("[]"))
        .otherwise(text)
    )
    docs = annotated(spark, sf_dir)
    return docs.withColumn("t", text).select(
        "doc_id", "markdown_main", "llm_register_annotation", raw.alias("raw")
    )


def as_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as lines of one file per language and source: (doc_id, path, doc_idx)."""
    docs = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("path"))
    return docs.withColumn("doc_idx", (F.row_number().over(Window.partitionBy("path").orderBy("doc_id")) - 1).cast("long"))


def rule_annotator() -> Provider:
    """Deterministic stand-in for the outside annotator: labels by line number, leaves some lines out.

    A line whose number is 4 modulo 9 is skipped unless it opens the block, so
    asking again over the missing span answers its first line only.
    """
    shown = re.compile(r"^\[(\d+)\] ")

    def answer(prompt: str) -> str:
        block = prompt.split("[CLASSIFY THESE LINES]\n", 1)[1].split("\n\n[CONTEXT", 1)[0]
        lines = [x for x in block.split("\n") if shown.match(x) and not x.endswith("{structural — do not classify}")]
        numbers = [int(shown.match(x).group(1)) for x in lines]
        items = []
        for k, n in enumerate(numbers):
            if n % 9 == 4 and k > 0:
                continue
            items.append(
                {
                    "line": n,
                    "mode_medium": "cannot_rate" if n % 5 == 0 else "transcribed" if n % 5 == 1 else "written",
                    "mode_turn": "dialogic" if n % 2 == 0 else "monologic",
                    "field_activity": ["recounting", "explaining", "directing", "evaluating", "news", None][n % 6],
                    "tenor_formality": "informal" if n % 3 == 0 else "formal",
                }
            )
        text = json.dumps(items)
        return f"```json\n{text}\n```" if numbers[:1] and numbers[0] % 2 else f"Here it is: {text}"

    return answer
