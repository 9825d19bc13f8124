"""The stages as jobs between files. Each takes paths and keyword options and writes its outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.functions import names as N
from registrum.functions.annotation import CANNOT_RATE
from registrum.operators import (
    centroids,
    compare,
    evaluation,
    features,
    labelling,
    lines,
    multivariate,
    reports,
    sampling,
    segments,
    xmltext,
)
from registrum.schemas import ANNOTATED_DOCUMENT, FEATURE_META, RAW_DOCUMENT, SECTIONS, SIMPLIFIED_DOCUMENT
from registrum.session import materialise
from registrum.sources import parser as parsers
from registrum.sources import numbering, sessions, snapshots, tables

Call = Callable[..., Column]
#: What names a document over all files of a stage: where it came from and its line there.
DOC_ID = "doc_id"
SIMPLIFIED_COLUMNS = ["xml_simplified", "markdown_main", "markdown_comments"]


def _simplified(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Simplified documents with their name; line numbers alone repeat from file to file."""
    return named(tables.read_documents(spark, path, SIMPLIFIED_DOCUMENT)).drop("path", "malformed")


def named(docs: DataFrame) -> DataFrame:
    return docs.withColumn(DOC_ID, F.concat_ws("#", "path", "doc_idx"))


def simplify(spark: SparkSession, base: str, output: str, name: str = tables.RAW_NAME) -> None:
    """Raw documents below ``base`` to simplified ones, one output partition per source folder.

    Keys the stage does not know are kept.
    """
    docs = tables.read_documents(spark, base, RAW_DOCUMENT, name, extra=True)
    done = xmltext.simplified_documents(docs)
    folder = F.regexp_extract("path", "([^/]*)/[^/]*$", 1)
    text = tables.merged_record(F.col("_record"), {c: F.col(c) for c in SIMPLIFIED_COLUMNS})
    done.select(folder.alias("folder"), text.alias("value")).write.mode("errorifexists").partitionBy("folder").text(output)


def label(spark: SparkSession, input_path: str | list[str], output: str, annotator: Call, start: int = 0,
          max_docs: int | None = None) -> None:
    """Annotate documents not yet in ``output`` and add them as one change.

    Documents are numbered over all files of ``input_path``, by file name and line. A run takes
    those from number ``start`` on that the output lacks, the first ``max_docs`` of them if given. Each has a name (file
    and line) in the output, so files may be added between runs, and a stopped run loses nothing and repeats nothing.
    """
    docs = tables.read_documents(spark, input_path, SIMPLIFIED_DOCUMENT)
    if start or max_docs is not None:
        docs = numbering.numbered(docs)
    docs = named(docs).drop("path", "malformed")
    if snapshots.exists(spark, output):
        docs = tables.remaining(docs, read_annotated(spark, output), DOC_ID)
    if start or max_docs is not None:
        docs = numbering.document_range(docs, start, max_docs).drop(numbering.NUMBER)
    snapshots.append(labelling.annotate(docs, annotator), output)


def read_annotated(spark: SparkSession, path: str) -> DataFrame:
    """Output of :func:`label`, which names its documents."""
    return snapshots.read(spark, path, f"{DOC_ID} string, doc_idx bigint, {ANNOTATED_DOCUMENT}")


def retry(spark: SparkSession, input_path: str | list[str], output: str, annotator: Call) -> None:
    """Annotate failed documents of ``output`` again and put the table in its own place."""
    ground, _ = snapshots.version(spark, output)
    merged = labelling.retry(_simplified(spark, input_path), read_annotated(spark, output), annotator, DOC_ID)
    snapshots.replace(merged, output, ground)


def compare_files(spark: SparkSession, first: str, second: str, max_docs: int | None = None, examples: int = 20,
                  seed: int | None = None) -> dict[str, DataFrame]:
    """Agreement of two annotated tables; of each the first ``max_docs`` documents by file and line, by default all."""

    def side(path: str) -> DataFrame:
        docs = read_annotated(spark, path)
        if max_docs is None:
            return docs
        file = F.substring_index(DOC_ID, "#", 1)
        return numbering.document_range(numbering.numbered(docs.withColumn("path", file)), 0, max_docs).drop("path", numbering.NUMBER)

    left, right = side(first), side(second)
    pairs = compare.matched(left, right, "doc_idx")
    texts = compare.matched(left, right, "doc_idx", with_text=True)
    counts = compare.cells(compare.compared_lines(pairs))
    return {
        "matches": compare.match_counts(left, right),
        "summary": compare.summary(pairs),
        "agreement": compare.facet_agreement(counts),
        "top_disagreements": compare.top_disagreements(counts),
        "examples": compare.examples(compare.disagreement_lines(texts), examples, seed),
    }


def sample(spark: SparkSession, input_path: str, output: str, n: int = 500, seed: int = 42, stratified: bool = False,
           floor: int = 5, sections: list[str] = SECTIONS) -> None:
    """Draw lines for human labelling and write them as one JSON array."""
    docs = read_annotated(spark, input_path)
    tasks = sampling.sample_documents(docs, n, seed, stratified, floor, sections, DOC_ID)
    tables.write_task_array(tasks, output)


def population(spark: SparkSession, input_path: str, sections: list[str] = SECTIONS) -> DataFrame:
    """Label distribution of all candidate lines."""
    from registrum.functions.annotation import label_key

    keys = lines.candidate_keys(read_annotated(spark, input_path), [DOC_ID], sections)
    return lines.label_distribution(keys, label_key(F.col("ann")))


def evaluate(spark: SparkSession, sessions_dir: str, output: str, truncate: bool = False, caps: Column | None = None) -> dict[str, str]:
    """Score exported sessions and write every report.

    ``caps`` scores only the first so many tasks of each session;
    ``names.task_cap(F.col("lang"))`` gives the numbers of the published evaluation.
    """
    tasks = sessions.session_tasks(sessions.read_sessions(spark, sessions_dir), caps)
    cells = materialise(evaluation.confusion_cells(tasks))
    texts = reports.all_reports(cells, truncate)
    for name, text in texts.items():
        tables.write_text(spark, text, f"{output}/{name}_report")
    return texts


def map_registers(spark: SparkSession, input_path: str, output: str, export: str | None = None) -> None:
    """Annotated documents to a table of segments with each document's name and number.

    ``export`` also writes bare JSON arrays, one document per line, file by file in
    document order, for readers that go by position; only that needs a range shuffle.
    Name its folder like a segment file (``fin_Latn_annotated.jsonl``) and :func:`parse`
    reads it as that file.
    """
    mapped = segments.map_segments(read_annotated(spark, input_path), [DOC_ID, "doc_idx"])
    mapped.write.mode("errorifexists").parquet(output)
    if export:
        named = spark.read.parquet(output).withColumn("file", F.substring_index(DOC_ID, "#", 1))
        tables.write_segments(named, export, ["file", "doc_idx"])


def parse(spark: SparkSession, input_path: str | list[str], output: str, factory: Callable, files: list[str] | None = None) -> None:
    """Parse segment files, or folders of :func:`map_registers`; the parser language follows from the name.

    Checks one row out per row in.
    """
    docs = tables.read_segments(spark, tables.chosen_paths(spark, input_path, files) if files else input_path)
    lang = N.parser_code(F.col("path"))
    unknown = docs.where(lang.isNull()).select("path").first()
    if unknown:
        raise ValueError(f"no parser language for {unknown['path']}")
    done = parsers.parse_segments(docs, lang, parsers.parser_udf(factory))
    done.write.mode("errorifexists").parquet(output)
    key = F.concat_ws("#", "path", "doc_idx").alias("key")
    tables.assert_one_to_one(docs.select(key), spark.read.parquet(output).select(key), "key")


def register_profile(spark: SparkSession, input_path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Data of the two profile charts: share of documents per register count, and length against labels."""
    docs = tables.read_segments(spark, input_path).withColumn("lang", N.display_language(F.col("path")))
    counts = docs.select("lang", segments.distinct_registers(F.transform("segments", lambda s: s["label"])).alias("n_reg"))
    shares = segments.mean_share_by_count(segments.register_count_distribution(counts))
    return shares, segments.length_and_registers(docs, ["path", "doc_idx"])


def concat(parts: dict[str, DataFrame]) -> DataFrame:
    """Parsed tables of script variants as one, segments tagged with their source."""
    return tables.concat_segments(parts)


def extract_features(spark: SparkSession, parsed_path: str, output: str, skip: list[str] = [],
                     exclude_labels: list[str] = [CANNOT_RATE], min_tokens: int = 0) -> list[str]:
    """Feature table and vocabulary of every merge group; returns the groups.

    Groups have different vocabularies, hence different columns, so each is a
    table of its own. Their number is that of the languages.
    """
    docs = tables.chosen_files(spark.read.parquet(parsed_path), skip=skip)
    path = F.col("path")
    tagged = docs.select(
        N.merge_group(path).alias("merge_group"),
        F.concat_ws(":", N.source_tag(path), F.col("doc_idx").cast("string")).alias("doc_id"),
        N.source_tag(path).alias("source"),
        F.substring_index("path", "/", -1).alias("file"),
        "segments",
    )
    groups = {
        r["merge_group"]: r["files"]
        for r in tagged.groupBy("merge_group").agg(F.array_sort(F.collect_set("file")).alias("files")).collect()
    }
    for group, files in sorted(groups.items()):
        own = tagged.where(F.col("merge_group") == group)
        keys = ["doc_id", "source"]
        records = materialise(features.recorded(features.segments_table(own, keys), keys, exclude_labels, min_tokens))
        tags = features.recorded_tags(records)
        record = features.vocabulary_record(tags, []).select(
            F.lit(group).alias("group"), F.array(*[F.lit(f) for f in files]).alias("source_files"), "upos", "deprel", "feats"
        )
        tables.write_documents(record.coalesce(1), f"{output}/{group}_vocabulary", mode="overwrite")
        wide = features.wide_features(records, keys, features.collected_vocabulary(tags))
        wide.select(*FEATURE_META, *[c for c in wide.columns if c not in FEATURE_META]).write.mode("overwrite").parquet(f"{output}/{group}_features")
    return sorted(groups)


def screen(spark: SparkSession, features_path: str, filtered: str, report: str, **options) -> multivariate.Screening:
    """Filtered feature table and the report of squared multiple correlations."""
    result = multivariate.screen(spark.read.parquet(features_path), **options)
    tables.write_small_csv(multivariate.smc_table(spark, result), report)
    result.data.write.mode("overwrite").parquet(filtered)
    return result


def factors(spark: SparkSession, filtered: str, output: str, rotation: str | None = "promax", **options) -> multivariate.FactorResult:
    """Factor analysis of a filtered table, with all its result tables."""
    result = multivariate.analyse(spark.read.parquet(filtered), rotation=rotation, **options)
    solution = result.solution
    small = {
        "loadings": multivariate.loadings_table(spark, solution),
        "communalities": multivariate.communalities_table(spark, solution),
        "scree_and_parallel": result.scree.orderBy("factor"),
        "variance_explained": multivariate.variance_table(spark, solution),
        "factor_correlations": multivariate.correlations_table(spark, solution),
    }
    for name, table in small.items():
        if table is not None:
            tables.write_small_csv(table, f"{output}/{name}")
    result.scores.write.mode("overwrite").parquet(f"{output}/scores")
    tables.write_text(spark, multivariate.summary_text(filtered.rsplit("/", 1)[-1], result, rotation), f"{output}/summary")
    return result


def compare_factor_counts(spark: SparkSession, filtered: str, report: str, **options) -> DataFrame:
    """Diagnostics for several numbers of factors."""
    data = spark.read.parquet(filtered)
    table = multivariate.compare_k(spark, multivariate.moments(data, multivariate.feature_columns(data)), **options)
    shown = table.withColumn("feats_per_factor", F.concat(F.lit("["), F.array_join("feats_per_factor", ", "), F.lit("]")))
    tables.write_small_csv(shown, report)
    return table


def inspect_dimensions(spark: SparkSession, factor_dir: str, threshold: float = multivariate.SALIENT) -> DataFrame:
    """Salient features of a written solution."""
    return multivariate.salient_poles(tables.read_csv(spark, f"{factor_dir}/loadings"), threshold)


def read_scores(spark: SparkSession, factor_dirs: dict[str, str]) -> DataFrame:
    """Scores of several languages; a factor a language lacks is null there."""
    frames = [spark.read.parquet(f"{p}/scores").withColumn("lang", F.lit(lang)) for lang, p in factor_dirs.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def plot_points(scores: DataFrame, pairs: list[str] = ["1,2"], combined: bool = False,
                bootstrap: bool = False, n_boot: int = centroids.BOOTSTRAP) -> dict[tuple[str, str], DataFrame]:
    """Register points of each factor pair, per language or combined."""
    out = {}
    keys = [c for c in FEATURE_META if c in scores.columns]
    for x, y in centroids.parse_pairs(pairs, scores.columns):
        if x not in scores.columns or y not in scores.columns:
            continue
        have = scores.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        points = centroids.centroids(have, ["lang", "label"], [x, y], 2 if combined else 1)
        if bootstrap:
            for f in (x, y):
                ci = centroids.bootstrap(have, ["lang", "label"], f, keys, n_boot).select(
                    "lang", "label", F.col("lo").alias(f"lo_{f}"), F.col("hi").alias(f"hi_{f}")
                )
                points = points.drop(f"lo_{f}", f"hi_{f}").join(ci, ["lang", "label"])
        out[x, y] = centroids.styled(points, "label", "lang" if combined else None)
    return out


def compare_dimension(scores: DataFrame, factor: str = "F1", sort_by: str | None = None,
                      exclude: list[str] = []) -> dict[str, DataFrame]:
    """Register means on one factor across languages, raw and normalised within language."""
    name = factor if factor.startswith("F") else f"F{factor}"
    kept = scores.where(~F.col("lang").isin(exclude) & F.col(name).isNotNull())
    return {
        "znorm": centroids.dimension(kept, name, True, sort_by),
        "raw": centroids.dimension(kept, name, False, sort_by),
    }
