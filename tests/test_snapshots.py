"""Numbers over files, cuts by them, and tables that change as a whole."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from registrum.plans import stages
from registrum.plans.standins import rule_annotator
from registrum.sources import annotator, numbering, snapshots
from registrum.streaming import ingest

SCHEMA = "k int, v string"


def rows(spark, path):
    return sorted(tuple(r) for r in snapshots.read(spark, path, SCHEMA).collect())


def test_numbers_over_files(spark):
    pick = random.Random(1)
    files = {f"f{pick.randint(0, 10**6):07d}": pick.randint(1, 30) for _ in range(50)}
    docs = [(f, i) for f, n in files.items() for i in range(n)]
    pick.shuffle(docs)
    got = numbering.numbered(spark.createDataFrame(docs, "path string, doc_idx long").repartition(5)).collect()
    assert {(r.path, r.doc_idx): r.doc_no for r in got} == {d: i for i, d in enumerate(sorted(docs))}


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_cut_by_digits(spark, monkeypatch, bits):
    monkeypatch.setattr(numbering, "STEP_BITS", bits)
    numbers = sorted(random.Random(2).sample(range(100_000), 300))
    docs = spark.createDataFrame([(n,) for n in numbers], "doc_no long")
    for start, n in ((0, 1), (0, 299), (0, 300), (0, 999), (numbers[7], 20), (50_000, 3), (99_999_999, 5), (0, 0)):
        got = sorted(r[0] for r in numbering.document_range(docs, start, n).collect())
        assert got == [x for x in numbers if x >= start][:n], (start, n)
    assert numbering.document_range(docs.where("false"), 0, 5).count() == 0


def simplified(tmp_path, folder, part, n):
    at = tmp_path / "simp" / f"folder={folder}"
    at.mkdir(parents=True, exist_ok=True)
    lines = [{"u": f"{folder}{part}{i}", "xml": "x", "xml_simplified": "x", "markdown_main": f"[1] text of {folder}{part}{i} stands here", "markdown_comments": ""} for i in range(n)]
    (at / f"part-{part}.txt").write_text("\n".join(json.dumps(x) for x in lines))


def test_steps_over_two_folders_take_each_document_once(spark, tmp_path):
    for folder in "ab":
        simplified(tmp_path, folder, 0, 5)
    ask, out = annotator.annotator_udf(rule_annotator), str(tmp_path / "out")
    seen = []
    for step in range(6):
        stages.label(spark, str(tmp_path / "simp"), out, ask, max_docs=2)
        seen.append({r["u"] for r in stages.read_annotated(spark, out).collect()})
    assert [len(s) for s in seen] == [2, 4, 6, 8, 10, 10] and stages.read_annotated(spark, out).count() == 10
    assert seen[0] == {"a00", "a01"} and seen[3] == {*(f"a0{i}" for i in range(5)), "b00", "b01", "b02"}
    first = stages.compare_files(spark, out, out, max_docs=3)
    assert first["matches"].first()["matched"] == 3
    other = str(tmp_path / "other")
    stages.label(spark, str(tmp_path / "simp"), other, ask, start=4, max_docs=2)  # a range over both files
    assert {r["u"] for r in stages.read_annotated(spark, other).collect()} == {"a04", "b00"}


def test_stream_then_batch_and_retry(spark, tmp_path):
    simplified(tmp_path, "a", 0, 4)
    ask, out = annotator.annotator_udf(rule_annotator), str(tmp_path / "out")
    source = str(tmp_path / "simp" / "folder=a")
    stages.label(spark, source, out, ask, max_docs=1)

    def stream():
        ingest.label_stream(spark, source, out, str(tmp_path / "cp"), ask, files_per_batch=1).awaitTermination(120)

    stream()
    simplified(tmp_path, "a", 1, 3)
    stream()
    stream()
    simplified(tmp_path, "b", 0, 2)
    stages.label(spark, str(tmp_path / "simp"), out, ask)
    done = stages.read_annotated(spark, out)
    assert sorted(r["u"] for r in done.collect()) == ["a00", "a01", "a02", "a03", "a10", "a11", "a12", "b00", "b01"]
    stages.retry(spark, str(tmp_path / "simp"), out, ask)
    done = stages.read_annotated(spark, out)
    assert done.count() == 9 == done.select("doc_id").distinct().count()
    stages.sample(spark, out, str(tmp_path / "tasks"), n=5)


def test_plain_folder_becomes_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert not snapshots.exists(spark, path) and rows(spark, path) == []
    spark.createDataFrame([(1, None), (2, "b")], SCHEMA).write.option("ignoreNullFields", "false").json(path)
    assert rows(spark, path) == [(1, None), (2, "b")] or rows(spark, path)
    snapshots.append(spark.createDataFrame([(3, "c")], SCHEMA), path)
    assert {r[0] for r in rows(spark, path)} == {1, 2, 3}
    snapshots.replace(snapshots.read(spark, path, SCHEMA).withColumn("v", F.coalesce("v", F.lit("new"))), path)  # reads its own path
    assert rows(spark, path) == [(1, "new"), (2, "b"), (3, "c")]


def test_same_token_is_one_change(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.createDataFrame([(1, "a")], SCHEMA)
    assert [snapshots.append(df, path, "batch-1"), snapshots.append(df, path, "batch-1"), snapshots.append(df, path, "batch-2")] == [True, False, True]
    assert rows(spark, path) == [(1, "a")] * 2


def test_writer_that_stops_leaves_the_table(spark, tmp_path, monkeypatch):
    path, df = str(tmp_path / "t"), spark.createDataFrame([(1, "a")], SCHEMA)
    snapshots.append(df, path)
    new = spark.createDataFrame([(2, "b")], SCHEMA)
    for stop in ("_write", "_commit"):
        with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
            real = getattr(snapshots, stop)

            def stopped(*args, real=real, stop=stop):
                if stop == "_write":
                    real(*args)  # the folder is there, the snapshot is not
                raise KeyboardInterrupt

            m.setattr(snapshots, stop, stopped)
            snapshots.replace(new, path)
        assert rows(spark, path) == [(1, "a")]
    (tmp_path / "t" / "_snapshots" / "000000000002").write_text("data-half")  # a snapshot cut off while it was written
    assert rows(spark, path) == [(1, "a")]
    snapshots.replace(new, path)
    assert rows(spark, path) == [(2, "b")]


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.append(spark.createDataFrame([(1, "a")], SCHEMA), path)
    ground, _ = snapshots.version(spark, path)
    stale = snapshots.read(spark, path, SCHEMA)
    snapshots.append(spark.createDataFrame([(2, "b")], SCHEMA), path)
    with pytest.raises(snapshots.ConflictError):
        snapshots.replace(stale, path, ground)
    assert rows(spark, path) == [(1, "a"), (2, "b")]


def test_readers_during_replacements(spark, tmp_path):
    path, stop, seen, failed = str(tmp_path / "t"), threading.Event(), set(), []
    snapshots.append(spark.createDataFrame([(0, "x"), (0, "x")], SCHEMA), path)

    def loop():
        while not stop.is_set():
            try:
                found = rows(spark, path)
                assert len(found) == 2 and found[0] == found[1]
                seen.add(found[0])
            except Exception as e:  # any failure counts
                failed.append(e)

    reader = threading.Thread(target=loop)
    reader.start()
    for i in range(1, 13):
        snapshots.replace(spark.createDataFrame([(i, "x"), (i, "x")], SCHEMA), path)
    stop.set()
    reader.join()
    assert not failed and len(seen) > 2
    assert len(list((tmp_path / "t").glob("data-*"))) == snapshots.KEEP
