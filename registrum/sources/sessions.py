"""Annotation sessions of people: tasks in, prefilled and confirmed labels, exports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from registrum.functions import text as T
from registrum.operators.lines import candidates
from registrum.schemas import FACET_VALUES, FACETS, LABELS, SESSION, TASK
from registrum.sources import tables


def coerce_labels(labels: Column) -> Column:
    """Empty strings count as no label; no annotation stays null."""
    return F.when(
        labels.isNotNull(), F.struct(*[F.nullif(labels[f], F.lit("")).alias(f) for f in FACETS]).cast(LABELS)
    )


def prefill(labels: Column) -> Column:
    """A person's starting labels: the model's, with no other facet on unrateable lines."""
    rated = F.coalesce(labels["mode_medium"], F.lit("")) != "cannot_rate"
    first = labels["mode_medium"].alias("mode_medium")
    return F.struct(first, *[F.when(rated, labels[f]).alias(f) for f in FACETS[1:]]).cast(LABELS)


def confirm(human: Column, llm: Column) -> Column:
    """The person's labels where given, else the prefilled ones."""
    return F.coalesce(human, prefill(llm))


def tasks_of_documents(docs: DataFrame, doc_key: str = "doc_idx", size: int = 5, limit: int = 500) -> DataFrame:
    """Every candidate line of annotated documents as a task, numbered within its document.

    (doc_idx, task_in_doc) identifies and orders the tasks; a running number
    over all documents would need one global order.
    """
    rows = candidates(docs, [doc_key, "u"], size=size, limit=limit)
    place = F.row_number().over(
        Window.partitionBy(doc_key).orderBy(F.when(F.col("section") == "main", 0).otherwise(1), "line_idx")
    )
    return rows.select(
        F.col(doc_key).alias("doc_idx"),
        "section",
        F.coalesce("u", F.lit("")).alias("url"),
        "line_idx",
        "line_num",
        "line_text",
        "context_before",
        "context_after",
        coerce_labels(F.col("ann")).alias("llm"),
        (place - 1).cast("bigint").alias("task_in_doc"),
    )


def read_tasks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tasks from a JSON array, or from annotated documents as JSON lines, told apart by the first character."""
    first = spark.read.text(path).where(~T.is_blank(F.col("value"))).limit(1).first()
    if first and first["value"].lstrip().startswith("["):
        task = StructType.fromDDL(f"task {TASK}")["task"].dataType
        return spark.read.option("multiLine", True).schema(task).json(path)
    return tasks_of_documents(tables.read_documents(spark, path, schema))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Exported sessions, one file per language: (lang, session columns)."""
    sessions = spark.read.option("multiLine", True).option("pathGlobFilter", "*_eval.json").schema(SESSION).json(path)
    lang = F.regexp_extract(F.col("_metadata.file_name"), "^(.*)_eval[.]json$", 1)
    return sessions.select(lang.alias("lang"), "*")


def session_tasks(sessions: DataFrame, cap: Column | None = None) -> DataFrame:
    """(lang, task_pos, human_labels, llm_labels), the first ``cap`` tasks of each session."""
    annotations = F.col("annotations") if cap is None else F.slice("annotations", F.lit(1), cap)
    fields = F.arrays_zip(
        F.transform(annotations, lambda a: a["human_labels"]).alias("human_labels"),
        F.transform(annotations, lambda a: a["llm_labels"]).alias("llm_labels"),
    )
    return sessions.select("lang", F.posexplode(fields).alias("task_pos", "t")).select(
        "lang", "task_pos", "t.human_labels", "t.llm_labels"
    )


def export_session(tasks: DataFrame, annotator: str, timestamp: str) -> DataFrame:
    """One session record from (task columns, llm, human_labels, touched).

    A session is one person's task list, which is a drawn sample.
    """
    from registrum.operators.compare import session_agreement

    agreement = session_agreement(tasks.withColumnRenamed("llm", "llm_labels"))
    record = F.struct(
        "task_id", "doc_idx", "section", "url", "line_num", "line_text", "context_before", "context_after",
        F.col("llm").alias("llm_labels"), "human_labels",
    )
    folded = tasks.agg(
        F.count(F.lit(1)).alias("total_tasks"),
        F.array_sort(F.collect_list(record)).alias("annotations"),
    )
    scheme = F.struct(*[F.array(*[F.lit(v) for v in values]).alias(f) for f, values in FACET_VALUES.items()])
    counts = agreement.select(F.struct("ag", "dis", "tot")).scalar()
    return folded.select(
        F.lit(annotator).alias("annotator"),
        F.lit(timestamp).alias("timestamp"),
        "total_tasks",
        scheme.alias("scheme"),
        counts.alias("agreement"),
        "annotations",
    )


def latest_states(states: DataFrame) -> DataFrame:
    """Saved states by annotator and file; the latest one counts."""
    payload = [c for c in states.columns if c not in ("annotator", "fingerprint")]
    return (
        states.groupBy("annotator", "fingerprint")
        .agg(F.max_by(F.struct(*payload), "saved_at").alias("s"))
        .select("annotator", "fingerprint", "s.*")
    )


_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def _base36(n: int) -> str:
    out = ""
    while n:
        n, d = divmod(n, 36)
        out = _DIGITS[d] + out
    return out or "0"


def _fingerprint(text: str) -> str:
    """Length and a 32-bit hash (start 5381, times 33 plus code unit), both in base 36."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2").astype(np.uint32)
    n = len(units)
    powers = np.ones(n + 1, dtype=np.uint32)
    powers[1:] = 33
    powers = np.multiply.accumulate(powers, dtype=np.uint32)
    value = (5381 * int(powers[n]) + int(np.dot(units.astype(np.uint64), powers[n - 1 :: -1][:n].astype(np.uint64)) if n else 0)) % 2**32
    return f"{_base36(n)}_{_base36(value)}"


def fingerprint(text: Column) -> Column:
    """Content fingerprint of a loaded file, over UTF-16 units of the trimmed text."""

    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(_fingerprint, na_action="ignore")

    batch.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, "string")(T.strip(text))
