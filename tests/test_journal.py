"""The queue of calls: same labels as the plain annotator, nothing asked twice, bounds on calls."""

import json
import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from registrum.operators import labelling
from registrum.plans.standins import rule_annotator
from registrum.sources import annotator as N
from registrum.sources import journal

SCHEMA = "doc_id string, u string, markdown_main string, markdown_comments string"


def docs(spark, n=6, lines=40):
    text = lambda i: "\n".join(f"[{k}] words {i} {k}" for k in range(1, lines + 1))
    return spark.createDataFrame([(f"file|a#{i}", f"u{i}", text(i), "[1] c\n[2] d") for i in range(n)] + [("none", "u", "", "")], SCHEMA)


def labels(df):
    return sorted((r["doc_id"], json.dumps(r["llm_register_annotation"].asDict(recursive=True))) for r in df.collect())


def counting(path, stop_at=None):
    """A provider that notes every prompt; the first time it sees ``stop_at`` its process dies."""

    def factory():
        answer = rule_annotator()

        def provider(prompt):
            if stop_at and stop_at in prompt.split("[CLASSIFY THESE LINES]")[1] and not os.path.exists(path + ".died"):
                open(path + ".died", "w").close()
                os._exit(1)
            with open(path, "a") as f:
                f.write(json.dumps(prompt) + "\n")
            return answer(prompt)

        return provider

    return factory


def asked(path):
    with open(path) as f:
        return Counter(f.read().splitlines())


@pytest.mark.parametrize("lanes,threads", [(1, 1), (3, 4)])
def test_labels_are_those_of_the_plain_annotator(spark, tmp_path, lanes, threads):
    want = labels(labelling.annotate(docs(spark), N.annotator_udf(rule_annotator)))
    path = str(tmp_path / "asked")
    queue = journal.Queue(str(tmp_path / "journal"), counting(path), lanes=lanes, threads=threads, backoff=0.0, roll=3)
    assert labels(labelling.annotate(docs(spark), queue)) == want
    first = asked(path)
    assert max(first.values()) == 1
    assert labels(labelling.annotate(docs(spark), queue)) == want and asked(path) == first  # all in the journal


def test_a_task_killed_midway_asks_nothing_twice(spark, tmp_path):
    path = str(tmp_path / "asked")
    queue = journal.Queue(str(tmp_path / "journal"), counting(path, "words 4 20"), lanes=1, backoff=0.0)
    with pytest.raises(Exception, match="crashed|exited|EOF|Connection"):
        labelling.annotate(docs(spark), queue).collect()
    before = sum(asked(path).values())
    assert before > 0
    for file in (tmp_path / "journal").glob("lane=*/*"):
        file.write_text(file.read_text() + '{"call": "cut o')  # what a crash may leave
    got = labels(labelling.annotate(docs(spark), queue))
    assert got == labels(labelling.annotate(docs(spark), N.annotator_udf(rule_annotator)))
    assert max(asked(path).values()) == 1 and sum(asked(path).values()) > before


def test_fatal_errors_stop_and_failures_are_kept(spark, tmp_path):
    def fatal():
        def provider(prompt):
            raise N.FatalAnnotatorError("no credit")

        return provider

    with pytest.raises(Exception, match="no credit"):
        labelling.annotate(docs(spark), journal.Queue(str(tmp_path / "a"), fatal, threads=3)).collect()

    def broken():
        def provider(prompt):
            raise ValueError("no answer")

        return provider

    queue = journal.Queue(str(tmp_path / "b"), broken, lanes=2, attempts=2, backoff=0.0)
    out = labelling.annotate(docs(spark, 2), queue)
    assert labelling.failed_documents(out).count() == 2


def test_concurrency_and_rate(spark, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()

    def factory():
        def provider(prompt):
            begin = time.time()
            time.sleep(0.15)
            (marks / f"{begin}-{time.time()}").touch()
            return "x"

        return provider

    calls = spark.range(24).select(F.col("id").cast("string").alias("call"), F.lit("p").alias("prompt"))
    assert journal.Queue(str(tmp_path / "j"), factory, lanes=2, threads=2).work_off(calls) == 24
    spans = [tuple(map(float, f.name.split("-"))) for f in marks.iterdir()]
    most = max(sum(a <= t < b for a, b in spans) for t, _ in spans)
    assert 2 <= most <= 4
    for f in marks.iterdir():
        f.unlink()
    journal.Queue(str(tmp_path / "k"), factory, lanes=2, threads=4, rate=8).work_off(calls)
    begins = sorted(float(f.name.split("-")[0]) for f in marks.iterdir())
    assert len(begins) == 24 and max(sum(t <= b < t + 1 for b in begins) for t in begins) <= 11
