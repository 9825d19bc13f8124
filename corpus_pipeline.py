"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns the columns of ``documents``; the last returns what training reads.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.llm import decontaminate, language_id, line_dedup, near_copies, streaming_bpe
from registrum.llm.common import crc_bucket, only, read, shared_folder, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text is in no language if its best one knows a smaller share of its trigrams than this part of what that language knows of its own texts.
LEAST_COVER = 0.2
#: Words of the shortest benchmark item that documents are dropped for.
LEAST_WORDS = 5
TOKENIZER = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have no letters or are in no learned language."""
    filters = language_id.learn(docs.where(crc_bucket(F.col("doc_id"), 3) != 1))
    keep = [F.col(c) for c in COLUMNS]
    found = language_id.predict(docs, filters, *keep)
    if not filters.languages:
        return only(found.where("false"), *COLUMNS)
    own = F.element_at(F.create_map(*[F.lit(x) for pair in filters.expected.items() for x in pair]), F.col("lang_pred"))  # a pair per language
    known = (F.col("cover") > 0) & (F.col("cover") >= LEAST_COVER * own)
    return only(found.where(F.col("lang_pred") != language_id.UNKNOWN).where(known), *COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many share."""
    return only(line_dedup.kept(only(docs, *COLUMNS)).withColumn("n_chars", F.length("text").cast("long")), *COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word Jaccard of 0.8), that with the smallest id; documents without an id stay."""
    folder, rows = shared_folder(spark), only(docs, *COLUMNS)
    found = written(near_copies.near_copies(docs), f"{folder}/found")
    # Written first, so that the size of what goes, less than what stays, is known before texts are moved for it.
    gone = written(found.where("doc_id <> component_id").select("doc_id").distinct(), f"{folder}/gone")
    stay = rows.join(gone, "doc_id", "left_anti")
    again = written(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), f"{folder}/again")
    if again.isEmpty():
        return stay
    # Repeated rows of one id are copies or ties of one document: the first by text stays.
    one = stay.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*COLUMNS[1:]), F.coalesce("text", F.lit(""))).alias("x"))
    return stay.join(again, "doc_id", "left_anti").unionByName(one.select("doc_id", "x.*"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item of ``LEAST_WORDS`` words or more, also with other numbers, names or units.

    Shorter items stand in ordinary texts too; op10 reports them, the pipeline drops nothing for them.
    """
    items = read(spark, sf_dir, "benchmark").where(F.size(F.split(F.trim("text"), r"\s+")) >= LEAST_WORDS)
    # Written first, so that the size of the few that go is known before texts are moved for them.
    hits = written(decontaminate.contaminated(docs, items).select("doc_id").distinct(), f"{shared_folder(spark)}/hits")
    return only(docs, *COLUMNS).join(hits, "doc_id", "left_anti")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and the text that they decode to."""
    path = public_tokenizers.path(TOKENIZER)
    found = streaming_bpe.transcoded(docs, path, F.col("doc_id"), F.col("lang"), F.col("source"), mode="text")
    return found.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("bpe", tokenise),
]

#: No stage's method (learned filters, SimHash tables, BPE) can be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = read(spark, sf_dir, "documents"), shared_folder(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return stage_last(spark, docs, sf_dir)


def stage_last(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return STAGES[-1][1](spark, docs, sf_dir)
