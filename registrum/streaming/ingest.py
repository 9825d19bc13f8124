"""Stages over a growing folder of files, exactly once per document.

The checkpoint remembers which files are done, which replaces counting output
rows to resume. ``availableNow`` works off what is there and stops.
"""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from registrum.operators import labelling, xmltext
from registrum.plans import stages
from registrum.schemas import RAW_DOCUMENT, SIMPLIFIED_DOCUMENT
from registrum.sources import snapshots, tables


def _source(spark: SparkSession, path: str, schema: str, files_per_batch: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def simplify_stream(spark: SparkSession, source: str, output: str, checkpoint: str,
                    files_per_batch: int = 1000) -> StreamingQuery:
    """Simplify raw documents as files arrive."""
    docs = xmltext.simplified_documents(_source(spark, source, RAW_DOCUMENT, files_per_batch))
    return (
        docs.writeStream.format("json")
        .option("ignoreNullFields", "false")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(output)
    )


def label_stream(spark: SparkSession, source: str, output: str, checkpoint: str, annotator: Callable[..., Column],
                 files_per_batch: int = 10) -> StreamingQuery:
    """Annotate simplified documents as files arrive.

    The output is that of :func:`stages.label`: documents named by file and line, in a table that
    changes as a whole. A batch leaves out what the table has, and is one change named by its
    number, so neither a batch repeated after a failure nor a run of the stage beside the stream doubles a document.
    """
    name = f"stream-{crc32(checkpoint.encode()):08x}"

    def write(batch: DataFrame, number: int) -> None:
        docs = tables.parse_documents(tables.number_lines(batch), SIMPLIFIED_DOCUMENT)
        docs = stages.named(docs).drop("path", "malformed")
        if snapshots.exists(batch.sparkSession, output):
            docs = tables.remaining(docs, stages.read_annotated(batch.sparkSession, output), stages.DOC_ID)
        snapshots.append(labelling.annotate(docs, annotator), output, f"{name}-{number}")

    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source)
    return (
        tables.split_lines(lines)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
