"""Files in and out, stages end to end, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from registrum.plans import stages
from registrum.plans.standins import rule_annotator
from registrum.schemas import RAW_DOCUMENT, SIMPLIFIED_DOCUMENT
from registrum.sources import annotator, sessions, tables
from registrum.streaming import ingest


def rule_parser(lang):
    """Stand-in for a parser: sentences end at full stops, words at blanks, each word hangs on the one before."""

    def parse(text):
        sentences = []
        for raw in text.split("."):
            words = raw.split()
            if words:
                tokens = [
                    {"id": i + 1, "text": w, "lemma": w.lower(), "upos": "NOUN" if len(w) > 3 else "DET", "xpos": None,
                     "feats": "", "head": i, "deprel": "root" if i == 0 else "dep", "start_char": None, "end_char": None}
                    for i, w in enumerate(words)
                ]
                sentences.append({"text": raw.strip(), "tokens": tokens})
        return sentences

    return parse


def test_line_numbers_across_splits(spark, tmp_path):
    values = {f"f{i}.jsonl": [f'{{"n": {j}, "pad": "{"x" * (j % 50)}"}}' for j in range(400 + i)] for i in range(3)}
    values["f1.jsonl"][7] = ""
    for name, rows in values.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        rows = tables.read_lines(spark, str(tmp_path))
        assert rows.select(F.spark_partition_id()).distinct().count() > 3
        got = {(r["path"].rsplit("/", 1)[1], r["line_idx"]): r["value"] for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(name, i): v for name, rows in values.items() for i, v in enumerate(rows)}


def test_documents_keep_unknown_keys(spark, tmp_path):
    (tmp_path / "a").mkdir()
    rows = ['{"xml": "<doc/>", "u": "h", "extra": {"k": [1, "2"]}, "n": 1.5, "z": null}', "not json"]
    (tmp_path / "a" / "shuffled.jsonl").write_text("\n".join(rows), encoding="utf-8")
    (tmp_path / "a" / "other.jsonl").write_text("{}")
    docs = tables.read_documents(spark, str(tmp_path), RAW_DOCUMENT, tables.RAW_NAME, extra=True)
    assert [r["malformed"] for r in docs.orderBy("doc_idx").collect()] == [False, True]
    good = docs.where(~F.col("malformed")).withColumn("u", F.lit("é"))
    text = good.select(tables.merged_record(F.col("_record"), {"u": F.col("u"), "new": F.lit(None).cast("string")})).first()[0]
    assert json.loads(text) == {"xml": "<doc/>", "extra": {"k": [1, "2"]}, "n": 1.5, "z": None, "u": "é", "new": None}


def test_ranges_resume_and_checks(spark):
    docs = spark.range(10).withColumnRenamed("id", "doc_idx")
    done = docs.where("doc_idx < 6")
    assert tables.remaining(docs, done, "doc_idx").count() == 4
    with pytest.raises(AssertionError):
        tables.assert_one_to_one(docs, done, "doc_idx")
    tables.assert_one_to_one(docs, docs.select("doc_idx"), "doc_idx")


def test_segment_files(spark, tmp_path):
    (tmp_path / "cmn_Hans_annotated.jsonl").write_text('[{"label":"A","text":"x"}]\n\nbroken [\n{"a":1}\n[]')
    docs = tables.read_segments(spark, str(tmp_path)).orderBy("doc_idx").collect()
    assert [len(r["segments"]) for r in docs] == [1, 0, 0, 0, 0]
    both = tables.concat_segments({"s1": tables.read_segments(spark, str(tmp_path)), "s2": tables.read_segments(spark, str(tmp_path))})
    assert both.count() == 10
    tags = both.select(F.explode("segments").alias("s")).select("s._source").collect()
    assert sorted(r[0] for r in tags) == ["s1", "s2"]
    shares, lengths = stages.register_profile(spark, str(tmp_path))
    assert {r["n_reg"]: r["mean"] for r in shares.collect()} == {0: 0.8, 1: 0.2}
    assert lengths.count() == 5


def test_only_chosen_files_are_read(spark, tmp_path):
    for name in ("a.jsonl", "b.jsonl", "_c.jsonl"):
        (tmp_path / name).write_text("[]")
    (tmp_path / "d.jsonl").mkdir()
    (tmp_path / "d.jsonl" / "part-0.txt").write_text("[]")
    names = lambda paths: [p.rsplit("/", 1)[1] for p in paths]
    root = str(tmp_path)
    assert names(tables.chosen_paths(spark, root)) == ["a.jsonl", "b.jsonl", "d.jsonl"]
    assert names(tables.chosen_paths(spark, root, ["a.jsonl", "d.jsonl"])) == ["a.jsonl", "d.jsonl"]
    assert names(tables.chosen_paths(spark, root, skip=["a.jsonl"])) == ["b.jsonl", "d.jsonl"]
    assert names(tables.chosen_paths(spark, [f"{root}/a.jsonl", f"{root}/d.jsonl"], ["d.jsonl"])) == ["d.jsonl"]
    docs = tables.read_segments(spark, tables.chosen_paths(spark, root, ["d.jsonl", "a.jsonl"]))
    assert sorted(names(r["path"] for r in docs.collect())) == ["a.jsonl", "d.jsonl"]
    assert {f.rsplit("/", 1)[1] for f in docs.inputFiles()} == {"a.jsonl", "part-0.txt"}


def test_sessions_round_trip(spark, tmp_path):
    labels = lambda m: (m, "monologic", "explaining", "formal")
    schema = (
        "task_id bigint, doc_idx bigint, section string, url string, line_num int, line_text string, "
        "context_before array<struct<num:int,text:string>>, context_after array<struct<num:int,text:string>>, "
        "llm struct<mode_medium:string,mode_turn:string,field_activity:string,tenor_formality:string>, "
        "human_labels struct<mode_medium:string,mode_turn:string,field_activity:string,tenor_formality:string>, touched boolean"
    )
    rows = [(i, 0, "main", "u", i, "t", [], [], labels("written"), labels("written" if i % 3 else "transcribed"), i < 120) for i in range(130)]
    tasks = spark.createDataFrame(rows, schema)
    record = sessions.export_session(tasks, "me", "2026-01-01T00:00:00Z").first()
    assert record["total_tasks"] == 130 and record["agreement"]["tot"] == 120 and record["agreement"]["dis"] == 40
    for lang in ("swe_Latn", "fin_Latn"):
        (tmp_path / f"{lang}_eval.json").write_text(json.dumps(record.asDict(recursive=True), indent=2))
    read = sessions.read_sessions(spark, str(tmp_path))
    counted = sessions.session_tasks(read, stages.N.task_cap(F.col("lang"))).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in counted} == {"swe_Latn": 100, "fin_Latn": 130}
    texts = stages.evaluate(spark, str(tmp_path), str(tmp_path / "out"), truncate=True, caps=stages.N.task_cap(F.col("lang")))
    assert "n=100, accuracy=0.660" in texts["swe_Latn"] and "POOLED ACROSS LANGUAGES (2)" in texts["pooled"]


def test_states_and_task_files(spark, tmp_path):
    states = spark.createDataFrame([("a", "f", 1, "x"), ("a", "f", 2, "y"), ("b", "f", 1, "z")], "annotator string, fingerprint string, saved_at int, state string")
    assert {tuple(r) for r in sessions.latest_states(states).select("annotator", "state").collect()} == {("a", "y"), ("b", "z")}
    task = {"task_id": 3, "line_text": "t", "llm": {"mode_medium": "written"}, "context_before": [{"num": 1, "text": "x"}]}
    (tmp_path / "tasks.json").write_text("\n [" + json.dumps(task) + "]")
    row = sessions.read_tasks(spark, str(tmp_path / "tasks.json"), SIMPLIFIED_DOCUMENT).first()
    assert row["task_id"] == 3 and row["llm"]["mode_medium"] == "written"
    doc = {"u": "h", "markdown_main": "[1] a\n[2] # s\n[3] b", "markdown_comments": "[1] c",
           "llm_register_annotation": {"main": [{"line": 1, "mode_medium": ""}], "comments": []}}
    (tmp_path / "docs.jsonl").write_text(json.dumps(doc) + "\n")
    schema = stages.ANNOTATED_DOCUMENT
    got = sessions.read_tasks(spark, str(tmp_path / "docs.jsonl"), schema).orderBy("task_in_doc").collect()
    assert [(r["section"], r["line_num"]) for r in got] == [("main", 1), ("main", 3), ("comments", 1)]
    assert got[0]["llm"] is not None and got[0]["llm"]["mode_medium"] is None and got[1]["llm"] is None


def xml(i):
    body = "".join(
        f"<p>{' '.join(w * (1 + (i + j + k) % 3) for k, w in enumerate(['alpha', 'b', 'gamma', 'de', 'epsilon'] * 4))}. End {j}.</p>"
        for j in range(4 + i % 5)
    )
    return f'<doc fingerprint="{i}"><main><head>Title {i}</head>{body}</main><comments><p>Nice {i} one.</p></comments></doc>'


def test_stages_end_to_end(spark, tmp_path):
    raw = tmp_path / "raw" / "eng_Latn"
    raw.mkdir(parents=True)
    rows = [{"xml": xml(i) if i % 9 else "<doc", "u": f"http://h/{i}", "keep": i} for i in range(60)]
    (raw / "shuffled.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    at = lambda name: str(tmp_path / name)

    stages.simplify(spark, at("raw"), at("simplified"))
    simplified = tables.read_documents(spark, at("simplified") + "/folder=eng_Latn", SIMPLIFIED_DOCUMENT)
    assert simplified.count() == 53

    ask = annotator.annotator_udf(rule_annotator)
    stages.label(spark, at("simplified") + "/folder=eng_Latn", at("annotated"), ask, max_docs=20)
    assert stages.read_annotated(spark, at("annotated")).count() == 20
    stages.label(spark, at("simplified") + "/folder=eng_Latn", at("annotated"), ask, max_docs=5)
    assert stages.read_annotated(spark, at("annotated")).count() == 25
    stages.label(spark, at("simplified") + "/folder=eng_Latn", at("annotated"), ask)
    annotated = stages.read_annotated(spark, at("annotated"))
    assert annotated.count() == 53 and annotated.select("doc_idx").distinct().count() == 53
    stages.retry(spark, at("simplified") + "/folder=eng_Latn", at("annotated"), ask)
    assert stages.read_annotated(spark, at("annotated")).count() == 53
    result = stages.compare_files(spark, at("annotated"), at("annotated"))
    assert result["matches"].first()["matched"] == 53
    assert all(r["disagree"] == 0 for r in result["agreement"].collect())
    stages.sample(spark, at("annotated"), at("tasks"), n=15, stratified=True)
    text = "".join(p.read_text() for p in sorted((tmp_path / "tasks").glob("part-*")))
    assert len(json.loads(text)) == 15
    assert stages.population(spark, at("annotated")).where("label = 'TOTAL'").count() == 1

    exports = [at("eng_Latn_annotated.jsonl"), at("fin_Latn_annotated.jsonl")]
    for i, export in enumerate(exports):
        stages.map_registers(spark, at("annotated"), at(f"segments{i}"), export)
    stages.parse(spark, exports, at("parsed"), rule_parser)
    parsed = spark.read.parquet(at("parsed"))
    assert parsed.count() == parsed.select("path", "doc_idx").distinct().count() == 106
    assert {r["path"].rsplit("/", 1)[-1] for r in parsed.select("path").distinct().collect()} == {"eng_Latn_annotated.jsonl", "fin_Latn_annotated.jsonl"}
    groups = stages.extract_features(spark, at("parsed"), at("features"))
    assert groups == ["eng_Latn", "fin_Latn"]
    features = spark.read.parquet(at("features") + "/eng_Latn_features")
    assert features.columns[:6] == ["doc_id", "source", "segment_idx", "label", "n_tokens", "n_sents"]
    assert features.first()["doc_id"].startswith("eng_Latn_annotated:")

    stages.screen(spark, at("features") + "/eng_Latn_features", at("filtered"), at("smc"), smc_threshold=0.0)
    found = stages.factors(spark, at("filtered"), at("fa"), n_factors=2, simulations=10)
    assert len(found.solution.factors) == 2
    stages.compare_factor_counts(spark, at("filtered"), at("k"), k_values=[2, 3])
    assert stages.inspect_dimensions(spark, at("fa"), 0.1).count() > 0
    scores = stages.read_scores(spark, {"eng": at("fa"), "copy": at("fa")})
    points = stages.plot_points(scores, ["all"], combined=True, bootstrap=True, n_boot=50)
    assert list(points) == [("F1", "F2")] and points["F1", "F2"].count() > 0
    assert stages.compare_dimension(scores, "1")["znorm"].count() > 0


def test_part_files_of_a_table_are_read_as_one_file(spark, tmp_path):
    folder = str(tmp_path / "fin_Latn_annotated.jsonl")
    rows = [(f"b/{i % 2}", i, [{"label": f"L{i}", "text": f"t{i}"}]) for i in range(40)]
    mapped = spark.createDataFrame(rows, "file string, doc_idx bigint, segments array<struct<label:string,text:string>>").repartition(7)
    tables.write_segments(mapped, folder, ["file", "doc_idx"])
    back = tables.read_segments(spark, folder).orderBy("doc_idx").collect()
    assert [r["doc_idx"] for r in back] == [*range(40)]
    assert [r["segments"][0]["text"] for r in back] == [f"t{i}" for i in [*range(0, 40, 2), *range(1, 40, 2)]]
    assert {r["path"].rsplit("/", 1)[-1] for r in back} == {"fin_Latn_annotated.jsonl"}


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    at = lambda name: str(tmp_path / name)

    def feed(n):
        (source / f"{n}.json").write_text("\n".join(json.dumps({"xml": xml(i), "u": str(i)}) for i in range(n * 5, n * 5 + 5)))
        ingest.simplify_stream(spark, str(source), at("out"), at("cp1")).awaitTermination(120)
        ask = annotator.annotator_udf(rule_annotator)
        ingest.label_stream(spark, at("out"), at("labelled"), at("cp2"), ask).awaitTermination(120)

    feed(0)
    feed(1)
    done = stages.read_annotated(spark, at("labelled"))
    assert sorted(int(r["u"]) for r in done.collect()) == list(range(10))


def test_documents_of_several_files_keep_their_own_labels(spark, tmp_path):
    """Two folders of two files each, labelled in three runs, then retried: each document once, with its own text."""
    for folder in "ab":
        for part in (0, 1):
            at = tmp_path / "simp" / f"folder={folder}"
            at.mkdir(parents=True, exist_ok=True)
            rows = [{"u": f"{folder}{part}{i}", "xml": "x", "xml_simplified": "x", "markdown_main": f"[1] text of {folder}{part}{i} stands here", "markdown_comments": ""} for i in range(3)]
            (at / f"part-{part}.txt").write_text("\n".join(json.dumps(r) for r in rows))
    ask, out = annotator.annotator_udf(rule_annotator), str(tmp_path / "annotated")
    stages.label(spark, str(tmp_path / "simp" / "folder=a"), out, ask)
    assert stages.read_annotated(spark, out).count() == 6
    for _ in range(2):
        stages.label(spark, str(tmp_path / "simp"), out, ask)
    rows = stages.read_annotated(spark, out).collect()
    assert len(rows) == 12 and len({r["doc_id"] for r in rows}) == 12 and len({r["u"] for r in rows}) == 12
    for path in (tmp_path / "annotated").glob("data-*/part-*"):  # take the labels of one document per folder away
        path.write_text("\n".join(json.dumps({**r, "llm_register_annotation": {"main": [], "comments": []}} if r["u"] in ("a00", "b00") else r) for r in map(json.loads, path.read_text().splitlines())))
        for crc in (tmp_path / "annotated").glob("data-*/.*.crc"):
            crc.unlink()
    stages.retry(spark, str(tmp_path / "simp"), out, ask)
    rows = stages.read_annotated(spark, out).collect()
    assert len(rows) == 12 and {r["u"] for r in rows} == {f"{f}{p}{i}" for f in "ab" for p in (0, 1) for i in range(3)}
    assert all(r["u"] in r["markdown_main"] and len(r["llm_register_annotation"]["main"]) == 1 for r in rows)
