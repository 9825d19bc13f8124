"""Reading and writing the files between stages."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from registrum.schemas import PARSED_SEGMENT, SEGMENT

RAW_NAME = "shuffled.jsonl"
# Name of a part file in a folder that Spark wrote.
PART = r"/part-\d+[^/]*$"


def read_lines(spark: SparkSession, path: str | list[str], name: str | None = None, tables_whole: bool = False) -> DataFrame:
    """Text files as (path, line_idx, value), numbered from 0 within each file.

    ``name`` searches the folders below ``path`` for files of that name. With
    ``tables_whole`` the part files of a folder that Spark wrote count as one file
    of the folder's name, numbered on from part to part. Rows
    carry no order of their own, so numbers come from where a split starts and
    the running row number inside it: one light pass counts rows per split,
    and the few split offsets are joined back.
    """
    reader = spark.read
    if name:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", name)
    return number_lines(split_lines(reader.text(path)), tables_whole)


def split_lines(text: DataFrame) -> DataFrame:
    """Lines of a text source, or stream, with the file and split that each comes from."""
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"), "value")


def number_lines(rows: DataFrame, tables_whole: bool = False) -> DataFrame:
    """:func:`read_lines` from split lines in the order they were read."""
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    splits = rows.groupBy("path", "_split").agg(F.min("_row").alias("_base"), F.count(F.lit(1)).alias("_n"))
    file = F.regexp_replace("path", PART, "") if tables_whole else F.col("path")
    order = Window.partitionBy(file).orderBy("path", "_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "path", "_split", (F.coalesce(F.sum("_n").over(order), F.lit(0)) - F.col("_base")).alias("_shift")
    )
    return rows.join(offsets, ["path", "_split"]).select(
        file.alias("path"), (F.col("_row") + F.col("_shift")).alias("line_idx"), "value"
    )


def chosen_paths(spark: SparkSession, path: str | list[str], files: list[str] | None = None, skip: list[str] = []) -> list[str]:
    """The named files (or folders that Spark wrote under such a name) at or directly below ``path``, or all but the skipped ones.

    Only names are listed, so what is not chosen is never read.
    """
    hadoop, out = spark._jvm.org.apache.hadoop.fs, []
    for given in [path] if isinstance(path, str) else path:
        at = hadoop.Path(given)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        below = [] if fs.getFileStatus(at).isFile() else [x.getPath() for x in fs.listStatus(at)]
        below = [x for x in below if not x.getName().startswith(("_", "."))]
        whole = not below or any(x.getName().startswith("part-") for x in below)
        for found in [at] if whole else below:
            if found.getName() not in skip and (not files or found.getName() in files):
                out.append(found.toString())
    return sorted(out)


def chosen_files(lines: DataFrame, files: list[str] | None = None, skip: list[str] = []) -> DataFrame:
    """Keep the named files, or all but the skipped ones."""
    name = F.substring_index("path", "/", -1)
    if files:
        return lines.where(name.isin(files))
    return lines.where(~name.isin(skip)) if skip else lines


def parse_documents(lines: DataFrame, schema: str, extra: bool = False) -> DataFrame:
    """JSON lines to (path, doc_idx, columns of ``schema``, malformed).

    ``extra`` keeps the whole record as ``_record``, a map of every key, so that
    keys the schema does not name survive to the output.
    """
    parsed = lines.select(
        "path",
        F.col("line_idx").alias("doc_idx"),
        F.from_json("value", schema).alias("_row"),
        F.expr("try_parse_json(value) IS NULL").alias("malformed"),
        *([F.from_json("value", "map<string,variant>").alias("_record")] if extra else []),
    )
    return parsed.select("path", "doc_idx", "_row.*", "malformed", *(["_record"] if extra else []))


def read_documents(spark: SparkSession, path: str | list[str], schema: str, name: str | None = None,
                   extra: bool = False) -> DataFrame:
    return parse_documents(read_lines(spark, path, name), schema, extra)


def read_segments(spark: SparkSession, path: str | list[str], parsed: bool = False) -> DataFrame:
    """Segment files, or folders written by :func:`write_segments`: (path, doc_idx, segments).

    Blank, malformed and non-list lines are empty lists.
    """
    item = PARSED_SEGMENT if parsed else SEGMENT
    lines = read_lines(spark, path, tables_whole=True)
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{item}>"))
    return lines.select(
        "path",
        F.col("line_idx").alias("doc_idx"),
        F.coalesce(listed, F.array().cast(f"array<{item}>")).alias("segments"),
    )


def concat_segments(parts: dict[str, DataFrame]) -> DataFrame:
    """Several sources of documents as one table, every segment tagged with its source."""

    def tag(source: str) -> Column:
        return F.transform("segments", lambda s: s.withField("_source", F.lit(source)))

    tagged = [docs.withColumn("segments", tag(source)) for source, docs in parts.items()]
    return reduce(DataFrame.unionByName, tagged)


def write_documents(docs: DataFrame, path: str, mode: str = "errorifexists", by: list[str] = []) -> None:
    """JSON lines with null keys kept."""
    writer = docs.write.mode(mode).option("ignoreNullFields", "false")
    (writer.partitionBy(*by) if by else writer).json(path)


def merged_record(record: Column, updates: dict[str, Column]) -> Column:
    """JSON text of a whole record with some keys set."""
    kept = F.map_filter(record, lambda k, v: ~k.isin(list(updates)))
    new = F.from_json(
        F.to_json(F.struct(*[c.alias(k) for k, c in updates.items()]), {"ignoreNullFields": "false"}),
        "map<string,variant>",
    )
    return F.to_json(F.map_concat(kept, new), {"ignoreNullFields": "false"})


def write_merged(docs: DataFrame, updates: list[str], path: str, mode: str = "errorifexists") -> None:
    """JSON lines of the original records with the stage's columns added."""
    text = merged_record(F.col("_record"), {c: F.col(c) for c in updates})
    docs.select(text.alias("value")).write.mode(mode).text(path)


def write_segments(mapped: DataFrame, path: str, order: str | list[str] = "doc_idx", mode: str = "errorifexists") -> None:
    """One bare JSON array of segments per line, in document order.

    A range partitioning by the order's columns keeps it across the part files.
    """
    order = [order] if isinstance(order, str) else order
    ordered = mapped.repartitionByRange(*order).sortWithinPartitions(*order)
    text = F.to_json("segments", {"ignoreNullFields": "false"})
    ordered.select(text.alias("value")).write.mode(mode).text(path)


def remaining(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs without an output row. Only keys of the output are read."""
    return inputs.join(done.select(key), key, "left_anti")


def one_to_one(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Counts both sides, and the keys only one side has. One shuffle of bare keys."""

    def side(df: DataFrame, i: int, o: int) -> DataFrame:
        return df.select(key, F.lit(i).alias("i"), F.lit(o).alias("o"))

    sums = side(inputs, 1, 0).unionByName(side(outputs, 0, 1)).groupBy(key).agg(
        F.sum("i").alias("i"), F.sum("o").alias("o")
    )
    return sums.agg(
        F.coalesce(F.sum("i"), F.lit(0)).alias("inputs"),
        F.coalesce(F.sum("o"), F.lit(0)).alias("outputs"),
        F.count_if(F.col("o") == 0).alias("missing"),
        F.count_if(F.col("i") == 0).alias("foreign"),
    )


def assert_one_to_one(inputs: DataFrame, outputs: DataFrame, key: str) -> None:
    row = one_to_one(inputs, outputs, key).first()
    if row["inputs"] != row["outputs"] or row["missing"] or row["foreign"]:
        raise AssertionError(f"not one to one: {row.asDict()}")


def write_small_csv(df: DataFrame, path: str) -> None:
    """A result table with a row per feature or factor, as one file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One report as one text file."""
    spark.createDataFrame([(line,) for line in text.split("\n")], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path)


def write_task_array(tasks: DataFrame, path: str, order: str = "task_id") -> None:
    """A drawn sample as one indented JSON array."""
    rows = [json.loads(r[0]) for r in tasks.orderBy(order).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    write_text(tasks.sparkSession, json.dumps(rows, ensure_ascii=False, indent=2), path)
