"""Tables of JSON lines whose readers never see a change half done.

A change writes a new folder beside the others and then one small file, the snapshot, that
lists the folders that make up the table from now on. Readers take the last snapshot that is
whole, so they see the table before the change or after it, and a writer that stops at any
point leaves the table as it was. Two writers at once: appends are put on top of each other,
a replacement whose ground has moved fails.

A plain folder of JSON lines is a table as it stands; its first change makes it one of these.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

LOG, END, PLAIN = "_snapshots", "end", "."
#: Snapshots whose folders stay for readers that began with them.
KEEP = 3


class ConflictError(RuntimeError):
    """Another writer changed the table since it was read."""


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _read(spark: SparkSession, path: str, name: str) -> list[str] | None:
    """Folders of a snapshot, or nothing while it is not whole."""
    stream = _fs(spark, path).open(_path(spark, path, LOG, name))
    try:
        lines = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
    finally:
        stream.close()
    return lines[:-2] if lines[-2:] == [END, ""] else None


def _log(spark: SparkSession, path: str) -> list[str]:
    fs, log = _fs(spark, path), _path(spark, path, LOG)
    return sorted(n for s in fs.listStatus(log) if (n := s.getPath().getName()).isdigit()) if fs.exists(log) else []


def version(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """Number and folders of the last whole snapshot; 0 and the plain folder, or nothing, before the first."""
    for name in reversed(_log(spark, path)):
        if (folders := _read(spark, path, name)) is not None:
            return int(name), folders
    fs, whole = _fs(spark, path), _path(spark, path)
    plain = fs.exists(whole) and any(not s.getPath().getName().startswith(("_", ".")) and s.isFile() for s in fs.listStatus(whole))
    return 0, [PLAIN] if plain else []


def exists(spark: SparkSession, path: str) -> bool:
    return bool(version(spark, path)[1])


def paths(spark: SparkSession, path: str) -> list[str]:
    """Folders that make up the table now."""
    return [path if f == PLAIN else f"{path}/{f}" for f in version(spark, path)[1]]


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table as it is now; later changes don't reach this frame."""
    found = paths(spark, path)
    return spark.read.schema(schema).json(found) if found else spark.createDataFrame([], schema)


def _commit(spark: SparkSession, path: str, number: int, folders: list[str]) -> bool:
    """Write the snapshot, if nobody else has written one of this number."""
    fs = _fs(spark, path)
    try:
        out = fs.create(_path(spark, path, LOG, f"{number:012d}"), False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName() or "already exists" in str(e.java_exception):
            return False
        raise
    try:
        out.write(bytearray("\n".join([*folders, END, ""]).encode()))
    finally:
        out.close()
    return True


def _next(spark: SparkSession, path: str) -> int:
    log = _log(spark, path)
    return int(log[-1]) + 1 if log else 1


def _write(df: DataFrame, path: str, name: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")


def append(df: DataFrame, path: str, token: str | None = None) -> bool:
    """Add rows. A ``token`` names the change: one that is in the table already is not made again."""
    spark = df.sparkSession
    name = f"data-{token or uuid.uuid4().hex}"
    if name in version(spark, path)[1]:
        return False
    _write(df, path, name)
    while True:
        folders = version(spark, path)[1]
        if name in folders:
            return False
        if _commit(spark, path, _next(spark, path), [*folders, name]):
            return True


def replace(df: DataFrame, path: str, ground: int | None = None, keep: int = KEEP) -> None:
    """Put ``df``, which may read the table, in its place. ``ground`` is the number of the version that it was made from."""
    spark = df.sparkSession
    ground = version(spark, path)[0] if ground is None else ground
    name = f"data-{uuid.uuid4().hex}"
    _write(df, path, name)
    number = _next(spark, path)
    if version(spark, path)[0] != ground or not _commit(spark, path, number, [name]):
        raise ConflictError(f"{path} has changed since version {ground}")
    clean(spark, path, keep)


def clean(spark: SparkSession, path: str, keep: int = KEEP) -> None:
    """Delete folders that only snapshots before the last ``keep`` name. What no snapshot names may be a change in the making and stays."""
    fs, log = _fs(spark, path), _log(spark, path)
    whole = [(name, folders) for name in log if (folders := _read(spark, path, name)) is not None]
    used = {f for _, folders in whole[-keep:] for f in folders}
    for name, folders in whole[:-keep]:
        for folder in {*folders} - used:
            if folder == PLAIN:
                for s in fs.listStatus(_path(spark, path)):
                    if s.isFile():
                        fs.delete(s.getPath(), False)
            else:
                fs.delete(_path(spark, path, folder), True)
        fs.delete(_path(spark, path, LOG, name), False)
