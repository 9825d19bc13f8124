"""Session construction and durable intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole documents travel to the XML and annotator workers, so batches stay small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


def get_session(master: str | None = None, app_name: str = "registrum", **conf: str) -> SparkSession:
    """Build or fetch a session. ``master`` stays unset on a cluster, where spark-submit names it."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names, if it names one."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` once as a table in shared storage and read it back.

    Used where a result is read several times or holds answers of an outside
    service: the lineage ends at the written files, so a lost executor never
    repeats the work before them. Without any folder the frame is kept in
    memory and on local disk, and lost parts are computed again.
    """
    spark = df.sparkSession
    if path is None:
        base = checkpoint_dir(spark)
        if base is None:
            return df.persist()
        path = f"{base.rstrip('/')}/registrum/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a small input at least one partition per core.

    Only inputs that arrive in fewer splits than the cluster has cores are
    moved; a large table has more splits than that and passes untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(2 * cores, *keys)


def built_once(build: Callable) -> Callable:
    """Build a column expression once per Spark context.

    Expressions refer to columns by name and never change, and each of their
    nodes costs a call into the JVM. Arguments must be plain values.
    """
    built: dict = {}

    @wraps(build)
    def cached(*args):
        key = tuple(tuple(a) if isinstance(a, list) else a for a in args)
        context = SparkContext._active_spark_context
        if built.get("context") is not context:
            built.clear()
            built["context"] = context
        if key not in built:
            built[key] = build(*args)
        return built[key]

    return cached
