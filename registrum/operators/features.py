"""Linguistic features of dependency-parsed segments.

A parsed segment is one record, so its features come out of that record alone,
for many segments at a time in Arrow batches: one sort for tag counts, one for
type-token ratios. From parses to the wide feature table there is no shuffle;
only discovering the vocabulary aggregates across documents, over distinct tags.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from registrum.functions import parses
from registrum.functions.annotation import CANNOT_RATE
from registrum.functions.arrays import total
from registrum.schemas import FEATURE_META, STRUCTURAL_FEATURES
from registrum.session import built_once, materialise

# A tag set is closed and small; far beyond this the input is not a tagged corpus.
MAX_VOCABULARY = 20_000
WINDOW = 50
PER = 1000.0
# Tag kinds in one sortable key: kind, then the raw tag.
KINDS = {"upos": "pos", "deprel": "dep", "feats": "morph"}
PLACE = StructType([StructField("segment_idx", IntegerType()), StructField("label", StringType())])


def segments_table(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per parsed segment: keys, segment_idx, label, sentences.

    Zipping the two fields reads only them from a file. It also keeps the
    optimizer from copying the array's whole computation into a size filter
    below, as it does when a bare column is exploded.
    """
    fields = F.arrays_zip(F.col("segments.label"), F.col("segments.parse"))
    return parsed.select(*keys, F.posexplode(fields).alias("segment_idx", "segment")).select(
        *keys,
        "segment_idx",
        F.coalesce("segment.label", F.lit("")).alias("label"),
        F.col("segment.parse.sentences").alias("sentences"),
    )


def _empty(type_name: str) -> Column:
    return F.array().cast(f"array<{type_name}>")


def _tag(kind: str, value: Column) -> Column:
    return F.concat(F.lit(kind + "\t"), value)


def _present(tokens: Column, name: str) -> Column:
    """Non-empty values of a token field."""
    return F.filter(F.transform(tokens, lambda t: F.coalesce(t[name], F.lit(""))), lambda x: x != "")


def _morph_items(feats: Column) -> Column:
    """``K=V`` items of a feature string; anything else is dropped."""
    return F.filter(F.split(feats, "[|]"), lambda kv: F.instr(kv, "=") > 0)


def distinct_tags(tokens: Column) -> Column:
    """Every tag key that occurs in the tokens."""

    def keyed(kind: str, values: Column) -> Column:
        return F.transform(F.array_distinct(values), lambda v: _tag(kind, v))

    feats = F.flatten(F.transform(F.array_distinct(_present(tokens, "feats")), _morph_items))
    return F.concat(
        keyed("upos", _present(tokens, "upos")), keyed("deprel", _present(tokens, "deprel")), keyed("feats", feats)
    )


def all_tokens(sentences: Column) -> Column:
    return F.flatten(F.transform(sentences, lambda s: s["tokens"]))


@built_once
def _distinct_tags() -> Column:
    return distinct_tags(all_tokens(F.col("sentences")))


def vocabulary_tags(segments: DataFrame, by: list[str] = []) -> DataFrame:
    """Distinct (kind, tag) over all segments, excluded labels included."""
    return _split_tags(segments.select(*by, F.explode(_distinct_tags()).alias("tag")).distinct(), by)


def _split_tags(tags: DataFrame, by: list[str] = []) -> DataFrame:
    return tags.select(
        *by,
        F.substring_index("tag", "\t", 1).alias("kind"),
        F.regexp_replace("tag", "(?s)^[^\t]*\t", "").alias("tag"),
    )


def vocabulary_record(tags: DataFrame, by: list[str]) -> DataFrame:
    """One row per group with its three sorted tag lists; morphology as [key, value] pairs."""

    def of(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("tag"))))

    record = tags.groupBy(*by).agg(of("upos").alias("upos"), of("deprel").alias("deprel"), of("feats").alias("_f"))
    pairs = F.array_sort(
        F.transform(
            "_f",
            lambda kv: F.array(F.substring_index(kv, "=", 1), F.regexp_replace(kv, "(?s)^[^=]*=", "")),
        )
    )
    return record.select(*by, "upos", "deprel", pairs.alias("feats"))


def collected_vocabulary(tags: DataFrame) -> list[str]:
    """Sorted tag keys of distinct (kind, tag) as a list, because a wide table needs its columns named before it is planned."""
    rows = tags.limit(MAX_VOCABULARY + 1).collect()
    if len(rows) > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} distinct tags")
    return sorted(f"{r['kind']}\t{r['tag']}" for r in rows)


def feature_name(tag_key: str) -> str:
    """Column name of a tag; different tags may share one."""
    kind, tag = tag_key.split("\t", 1)
    if kind == "upos":
        tag = tag.lower()
    if kind == "feats":
        tag = "_".join(tag.split("=", 1))
    name = f"{KINDS[kind]}_{tag}"
    return name.replace(":", "_").replace("=", "_").replace("|", "_")


def columns_of(vocabulary: list[str]) -> dict[str, str]:
    """Column to tag key. Among tags sharing a column the last in vocabulary order counts."""
    kind_order = list(KINDS)

    def order(key: str) -> tuple:
        kind, tag = key.split("\t", 1)
        return kind_order.index(kind), tag.split("=", 1) if kind == "feats" else [tag]

    return {feature_name(k): k for k in sorted(vocabulary, key=order)}


def _content(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: F.coalesce(t["upos"], F.lit("")) != "PUNCT")


def measure(segments: DataFrame, keys: list[str], exclude_labels: list[str] = [CANNOT_RATE],
            min_tokens: int = 0) -> DataFrame:
    """Segments with their tokens and token counts; segments without content words are dropped.

    Label and emptiness filters come first, on columns the scan already has.
    """
    kept = segments.where(F.size("sentences") > 0)
    if exclude_labels:
        kept = kept.where(~F.col("label").isin(exclude_labels))
    lengths = F.filter(
        F.transform(
            F.filter("sentences", lambda s: F.size(s["tokens"]) > 0), lambda s: F.size(_content(s["tokens"]))
        ),
        lambda n: n > 0,
    )
    counted = kept.select(
        *keys,
        "segment_idx",
        "label",
        all_tokens(F.filter("sentences", lambda s: F.size(s["tokens"]) > 0)).alias("tokens"),
        lengths.alias("sent_lengths"),
    )
    return (
        counted.withColumn("n_tokens", total(F.col("sent_lengths")))
        .withColumn("n_sents", F.size("sent_lengths").cast("bigint"))
        .where((F.col("n_tokens") > 0) & (F.col("n_tokens") >= min_tokens))
    )


def structural_table(records: DataFrame, keys: list[str]) -> DataFrame:
    """Sentence length, dependency distance, word length and moving type-token ratios of the kept ``records``."""
    return records.where("kept").select(*keys, "segment_idx", "label", "n_tokens", "n_sents", "means.*")


def rates_long(records: DataFrame, keys: list[str]) -> DataFrame:
    """Long form of the kept ``records``: one row per segment and occurring tag with its rate per thousand content words."""
    return records.where("kept").select(*keys, "segment_idx", "n_tokens", F.inline("counts")).select(
        *keys,
        "segment_idx",
        F.substring_index("value", "\t", 1).alias("kind"),
        F.regexp_replace("value", "(?s)^[^\t]*\t", "").alias("tag"),
        "n",
        (F.lit(PER) * F.col("n") / F.col("n_tokens")).alias("rate"),
    )


def recorded(segments: DataFrame, keys: list[str], exclude_labels: list[str] = [CANNOT_RATE], min_tokens: int = 0) -> DataFrame:
    """A row per segment without its tokens: sizes, the tags it holds and, if it is ``kept``, sparse tag counts and structural means.

    All that the vocabulary and the feature tables need, so that parses are read and counted once.
    """
    segments = segments.select(*keys, "segment_idx", "label", "sentences")
    carried = segments.columns[:-1]

    def record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parses.parts(batch, "sentences"):
                found = parses.records_of(part.column("sentences"), WINDOW)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *found.values()], names=[*carried, *found])

    found = segments.mapInArrow(record, _record_schema(segments.select(*carried).schema))
    return _kept_records(found, carried, exclude_labels, min_tokens)


def recorded_texts(mapped: DataFrame, keys: list[str], parse: Callable[[pa.Array], pa.StructArray],
                   exclude_labels: list[str] = [CANNOT_RATE], min_tokens: int = 0) -> DataFrame:
    """:func:`recorded` of documents' segments (label, text) that ``parse`` takes apart in the same worker.

    ``parse`` gives texts their parses in the parser stage's layout. Tokens are many times their texts; here they
    neither travel between workers and Spark nor become rows.
    """
    rows = mapped.select(*keys, "segments")

    def record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parses.text_parts(batch, "segments"):
                yield _text_records(part, parse)

    place = StructType(rows.schema.fields[:-1] + PLACE.fields)
    return _kept_records(rows.mapInArrow(record, _record_schema(place)), [f.name for f in place], exclude_labels, min_tokens)


def _text_records(part: pa.RecordBatch, parse: Callable[[pa.Array], pa.StructArray]) -> pa.RecordBatch:
    """Keys, place, label and record of every segment of documents (keys, segments)."""
    segments = part.column("segments")
    owner = parses.owners(segments)
    label, text = (pc.struct_field(segments.flatten(), f) for f in ("label", "text"))
    found = parses.records_of(pc.struct_field(parse(text), "sentences"), WINDOW)
    columns = {n: part.column(n).take(pa.array(owner)) for n in part.schema.names[:-1]}
    columns["segment_idx"] = pa.array(parses.places(owner, len(segments)), pa.int32())
    columns["label"] = pc.fill_null(label, "")
    return pa.RecordBatch.from_pydict(columns | found)


def _record_schema(carried: StructType) -> StructType:
    return StructType(carried.fields + StructType.fromDDL(
        "n_tokens bigint, n_sents bigint, tags array<string>, counts array<struct<value: string, n: int>>, "
        f"means struct<{', '.join(f'{n}: double' for n in STRUCTURAL_FEATURES)}>"
    ).fields)


def _kept_records(records: DataFrame, carried: list[str], exclude_labels: list[str], min_tokens: int) -> DataFrame:
    kept = (F.col("n_tokens") > 0) & (F.col("n_tokens") >= min_tokens)
    if exclude_labels:
        kept = kept & ~F.col("label").isin(exclude_labels)
    return records.withColumn("kept", F.coalesce(kept, F.lit(False))).select(
        *carried,
        "n_tokens",
        "n_sents",
        "kept",
        "tags",
        F.when(F.col("kept"), F.col("counts")).alias("counts"),
        F.when(F.col("kept"), F.col("means")).alias("means"),
    )


def recorded_tags(records: DataFrame) -> DataFrame:
    """Distinct (kind, tag) over all segments, kept or not."""
    return _split_tags(records.select(F.explode("tags").alias("tag")).distinct())


def wide_features(records: DataFrame, keys: list[str], vocabulary: list[str]) -> DataFrame:
    """Wide form of the kept ``records``: metadata, then one column per feature in name order, zero where a tag is absent."""
    counted = records.where("kept").withColumn("_counts", F.map_from_entries("counts"))
    columns = {
        name: F.lit(PER) * F.coalesce(F.col("_counts")[key], F.lit(0)) / F.col("n_tokens")
        for name, key in columns_of(vocabulary).items()
    }
    columns.update({n: F.col("means")[n] for n in STRUCTURAL_FEATURES})
    return counted.select(
        *keys, "segment_idx", "label", "n_tokens", "n_sents", *[columns[n].alias(n) for n in sorted(columns)]
    )


def extract(parsed: DataFrame, vocabulary: list[str] | None = None, exclude_labels: list[str] = [CANNOT_RATE],
            min_tokens: int = 0) -> DataFrame:
    """Parsed documents (doc_id, source, segments) to the wide feature table.

    Without a vocabulary the segments' records are written once, and both the vocabulary and
    the table are read from them.
    """
    keys = ["doc_id", "source"]
    records = recorded(segments_table(parsed, keys), keys, exclude_labels, min_tokens)
    if vocabulary is None:
        records = materialise(records)
        vocabulary = collected_vocabulary(recorded_tags(records))
    wide = wide_features(records, keys, vocabulary)
    features = [c for c in wide.columns if c not in FEATURE_META]
    return wide.select(*FEATURE_META, *features)


@dataclass
class Widened:
    """A feature table that workers make of stored blocks: passes over it may read the blocks and widen them where they count."""

    data: DataFrame
    blocks: DataFrame
    widen: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def text_blocks(mapped: DataFrame, parse: Callable[[pa.Array], pa.StructArray]) -> DataFrame:
    """Records of documents' segments that ``parse`` takes apart on the way, as blocks of many segments, each with its distinct tags."""

    def record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parses.text_parts(batch, "segments"):
                records = _text_records(part, parse)
                tags, block = parses.block_of(records)
                yield pa.RecordBatch.from_arrays([pa.array([tags], pa.list_(pa.string())), pa.array([block], pa.binary())], ["tags", "block"])

    return mapped.select("doc_id", "source", "segments").mapInArrow(record, "tags array<string>, block binary")


def _widened(mapped: DataFrame, blocks: DataFrame, vocabulary: list[str], exclude_labels: list[str], min_tokens: int) -> Widened:
    columns = columns_of(vocabulary)
    features = sorted([*columns, *STRUCTURAL_FEATURES])
    place = mapped.select("doc_id", "source").schema.fields + PLACE.fields
    meta = StructType(place + StructType.fromDDL("n_tokens bigint, n_sents bigint").fields)
    schema = StructType(meta.fields + [StructField(c, DoubleType()) for c in features])

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block"):
                kept = parses.kept_of(parses.records_in(block.as_buffer()), exclude_labels, min_tokens)
                found = parses.rates_of(kept, columns, PER) | parses.means_of(kept)
                yield pa.RecordBatch.from_pydict({n: kept.column(n) for n in meta.names} | {c: found[c] for c in features})

    blocks = blocks.select("block")
    return Widened(blocks.mapInArrow(widen, schema).select(*FEATURE_META, *features), blocks, widen)


def widened_texts(mapped: DataFrame, parse: Callable[[pa.Array], pa.StructArray], exclude_labels: list[str] = [CANNOT_RATE],
                  min_tokens: int = 0) -> Widened:
    """:func:`extract` of documents' segments that ``parse`` takes apart on the way.

    Records are written as blocks of many segments and become the wide table's columns
    in the workers, so that tags are no strings of single rows on the way there.
    """
    blocks = materialise(text_blocks(mapped, parse))
    return _widened(mapped, blocks, collected_vocabulary(recorded_tags(blocks)), exclude_labels, min_tokens)


def extract_texts(mapped: DataFrame, parse: Callable[[pa.Array], pa.StructArray], vocabulary: list[str] | None = None,
                  exclude_labels: list[str] = [CANNOT_RATE], min_tokens: int = 0) -> DataFrame:
    """The table of :func:`widened_texts`; with a vocabulary nothing is written."""
    if vocabulary is None:
        return widened_texts(mapped, parse, exclude_labels, min_tokens).data
    return _widened(mapped, text_blocks(mapped, parse), vocabulary, exclude_labels, min_tokens).data


def token_stats(features: DataFrame, by: list[str] = []) -> DataFrame:
    """Smallest, median and largest content-word count, and the number of segments."""
    return features.groupBy(*by).agg(
        F.count(F.lit(1)).alias("segments"),
        F.min("n_tokens").alias("min_tokens"),
        F.percentile("n_tokens", F.lit(0.5)).cast("bigint").alias("median_tokens"),
        F.max("n_tokens").alias("max_tokens"),
    )
