"""Prompts, the annotator interface and the labelling stage."""

import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from registrum.operators import labelling
from registrum.schemas import SECTION_PAIR
from registrum.sources import annotator as N

SCHEMA = "doc_id int, u string, markdown_main string, markdown_comments string"


def docs(spark, *rows):
    return spark.createDataFrame([(i, "http://x", *r) for i, r in enumerate(rows)], SCHEMA)


def lines(n, prefix="t"):
    return "\n".join(f"[{i}] {prefix}{i}" for i in range(1, n + 1))


def labels(df):
    rows = df.orderBy("doc_id").select("llm_register_annotation").collect()
    return [
        {s: [tuple(a) for a in r[0][s]] for s in ("main", "comments")} for r in rows
    ]


def run(spark, answer, *rows):
    return labels(labelling.annotate(docs(spark, *rows), N.annotator_udf(lambda: answer, backoff=0.0)))


def numbers(prompt):
    block = prompt.split("[CLASSIFY THESE LINES]\n")[1].split("\n\n")[0]
    return [int(x[1 : x.index("]")]) for x in block.split("\n")]


def item(n, medium="written"):
    return {"line": n, "mode_medium": medium, "mode_turn": "dialogic", "field_activity": "creating", "tenor_formality": "informal"}


def test_prompt_layout(spark):
    md = "\n".join(["[1] # head"] + [f"[{i}] t{i}" for i in range(2, 40)])
    rows = labelling.plan_calls(docs(spark, (md, "")), ["doc_id"]).orderBy("begin").collect()
    assert [(r["begin"], r["end"]) for r in rows] == [(0, 15), (15, 30), (30, 39)]
    first, second = rows[0]["prompt"], rows[1]["prompt"]
    assert first.startswith("URL: http://x\nSection: main\n\n[CLASSIFY THESE LINES]\n[1] # head  {structural — do not classify}\n[2] t2")
    assert "[DOCUMENT OPENING — for context only, do not classify]\n[2] t2\n[3] t3\n[4] t4\n[5] t5\n[6] t6\n\n" in second
    assert "[CONTEXT — do not classify]\n[6] t6\n" in second and second.endswith("[31] t31\n[32] t32\n[33] t33\n[34] t34\n[35] t35\n[36] t36\n[37] t37\n[38] t38\n[39] t39")


def test_full_answer_and_comments(spark):
    answer = lambda p: json.dumps([item(n, "transcribed") for n in numbers(p)])
    got = run(spark, answer, ("[1] # h\n[2] a", "[1] c"))[0]
    assert got["main"] == [(1, "cannot_rate", None, None, None, True), (2, "transcribed", "dialogic", "creating", "informal", None)]
    assert got["comments"][0][1] == "written"


def test_missing_lines_are_asked_again_and_overwrite(spark):
    def answer(prompt):
        asked = numbers(prompt)
        if len(asked) == 6:
            return json.dumps([item(n) for n in (1, 3, 4, 6)])
        assert asked == [2, 3, 4, 5]
        return json.dumps([item(n, "transcribed") for n in (2, 3)])

    got = run(spark, answer, (lines(6), ""))[0]["main"]
    assert [a[1] for a in got] == ["written", "transcribed", "transcribed", "written", "cannot_rate", "written"]


def test_unusable_answers(spark):
    def answer(prompt):
        if "prose" in prompt:
            return "no idea"
        if "shape" in prompt:
            return '["a"]'
        if "down" in prompt:
            raise OSError("gone")
        return json.dumps([item(n) for n in numbers(prompt)])

    got = run(spark, answer, (lines(2, "prose"), "[1] ok"), (lines(2, "shape"), "[1] ok"), (lines(2, "down"), "[1] ok"), ("[1] # a\n[2] CODE: b", ""))
    assert [a[1] for a in got[0]["main"]] == ["cannot_rate"] * 2
    assert got[1]["main"] == [] and got[2]["main"] == []
    assert all(g["comments"][0][1] == "written" for g in got[:3])
    assert [a[5] for a in got[3]["main"]] == [True, True]


def test_ask_policy():
    waits, calls = [], []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert N.ask(flaky, "p", sleep=waits.append) == "ok" and waits == [2.0, 4.0]
    assert N.ask(lambda p: "  ", "p", sleep=waits.append) is None and waits == [2.0, 4.0, 2.0, 4.0]

    def fatal(prompt):
        calls.append("f")
        raise N.FatalAnnotatorError("402")

    with pytest.raises(N.FatalAnnotatorError):
        N.ask(fatal, "p", sleep=waits.append)
    assert calls.count("f") == 1


def test_chat_completions():
    class Reply:
        def __init__(self, data):
            self.data = data

        def read(self):
            return json.dumps(self.data).encode()

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

    def provider(result):
        def open_url(request, timeout):
            body = json.loads(request.data)
            assert body["temperature"] == 0 and body["max_tokens"] == 4096 and body["messages"][1]["content"] == "hi"
            if isinstance(result, int):
                raise urllib.error.HTTPError("u", result, "m", {}, None)
            return Reply(result)

        return N.ChatCompletions("http://e", "m", "k", "sys", open_url)()

    assert provider({"choices": [{"message": {"content": "yes"}}]})("hi") == "yes"
    for fatal in (401, 402, 403, {"error": {"code": 402}}, {"error": {"code": "insufficient_credits"}}):
        with pytest.raises(N.FatalAnnotatorError):
            provider(fatal)("hi")
    with pytest.raises(RuntimeError):
        provider({"error": "odd"})("hi")
    with pytest.raises(urllib.error.HTTPError):
        provider(500)("hi")


def test_fatal_error_stops_the_job(spark):
    def fatal(prompt):
        raise N.FatalAnnotatorError("no credit")

    with pytest.raises(Exception, match="no credit"):
        labelling.annotate(docs(spark, ("[1] a", "")), N.annotator_udf(lambda: fatal)).collect()


def test_retry_replaces_failed_documents_only(spark):
    ok = [(1, "written", "monologic", "explaining", "formal", None)]
    output = spark.createDataFrame(
        [(0, "[1] a", "", (ok, [])), (1, "[1] a", "[1] c", (ok, [])), (2, "[1] down", "[1] c", ([], ok)), (3, "[1] a", "", None)],
        f"doc_id int, markdown_main string, markdown_comments string, llm_register_annotation {SECTION_PAIR}",
    )
    assert sorted(r["doc_id"] for r in labelling.failed_documents(output).collect()) == [1, 2, 3]

    def answer(prompt):
        if "down" in prompt:
            raise OSError
        return json.dumps([item(n) for n in numbers(prompt)])

    inputs = docs(spark, ("[1] a", ""), ("[1] a", "[1] c"), ("[1] down", "[1] c"), ("[1] a", ""))
    got = labels(labelling.retry(inputs, output, N.annotator_udf(lambda: answer, backoff=0.0), "doc_id"))
    assert got[0]["main"][0][2] == "monologic" and got[1]["main"][0][2] == "dialogic"
    assert got[2]["main"] == [] and got[2]["comments"][0][2] == "dialogic"
    assert got[3]["main"][0][2] == "dialogic"
