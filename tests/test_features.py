"""Segments, tag rates and structural means."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from registrum.functions import parses
from registrum.operators import features, multivariate, segments
from registrum.plans import queries
from registrum.plans import standins as S
from registrum.schemas import PARSED_SEGMENT

GOLDEN = [
    (1, "Dogs", "dog", "NOUN", None, "Number=Plur", 2, "nsubj", None, None),
    (2, "bark", "bark", "VERB", None, "Mood=Ind|Number=Plur", 0, "root", None, None),
    (3, ".", ".", "PUNCT", None, None, 2, "punct", None, None),
]


def parsed(spark, docs):
    return spark.createDataFrame(docs, f"doc_id string, source string, segments array<{PARSED_SEGMENT}>")


def test_golden_features(spark):
    docs = parsed(spark, [("d:0", "d", [("Opinion", "Dogs bark.", ([("Dogs bark.", GOLDEN)],), None)])])
    row = features.extract(docs).first().asDict()
    want = {
        "n_tokens": 2, "n_sents": 1, "pos_noun": 500, "pos_verb": 500, "pos_punct": 500, "dep_nsubj": 500, "dep_root": 500,
        "dep_punct": 500, "morph_Number_Plur": 1000, "morph_Mood_Ind": 500, "mean_sent_len": 2, "mean_dep_dist": 1,
        "mean_word_len": 4, "mattr50_words": 1, "mattr50_lemmas": 1,
    }
    assert {k: row[k] for k in want} == want


def test_edge_segments(spark):
    tok = lambda i, text, upos, deprel="x": (i, text, None, upos, None, None, i - 1, deprel, None, None)
    segs = [
        ("A", "", None, None),
        ("Cannot rate", "t", ([("t", [tok(1, "t", "INTJ")])],), None),
        ("A", "!", ([("!", [tok(1, "!", "PUNCT")])],), None),
        ("A", "ab", ([("ab", [tok(1, "ab", None), tok(2, "Ab", "NOUN"), tok(3, "c", "noun")]), ("", [])],), None),
    ]
    docs = parsed(spark, [("d:0", "d", segs)])
    rows = features.extract(docs).collect()
    assert [r["segment_idx"] for r in rows] == [3]
    row = rows[0].asDict()
    # The vocabulary covers excluded segments; a missing tag counts as X, which is not in it.
    assert row["pos_intj"] == 0 and "pos_x" not in row
    # Two tags share a column: the later in order counts alone.
    assert row["pos_noun"] == pytest.approx(1000 / 3)
    assert row["mattr50_words"] == pytest.approx(2 / 3)
    record = features.vocabulary_record(features.vocabulary_tags(features.segments_table(docs, ["doc_id"])), []).first()
    assert record["upos"] == ["INTJ", "NOUN", "PUNCT", "noun"]
    assert features.extract(docs, min_tokens=4).count() == 0


def test_merge_runs_across_sections(spark):
    rows = [[("Opinion", "a"), ("Opinion", "b"), ("Spoken", "c"), ("Spoken", "d")], []]
    df = spark.createDataFrame([(r,) for r in rows], "x array<struct<label:string,text:string>>")
    got = [r[0] for r in df.select(segments.merge_runs(F.col("x"))).collect()]
    assert [[tuple(s) for s in g] for g in got] == [[("Opinion", "a b"), ("Spoken", "c d")], []]


def test_distinct_registers(spark):
    df = spark.createDataFrame([(["Cannot rate", "Opinion", "Opinion", "Spoken"],), (list("abcdefgh"),)], "x array<string>")
    assert [r[0] for r in df.select(segments.distinct_registers(F.col("x"))).collect()] == [2, 6]


def test_flagship_values(spark):
    from __spark_entry__ import entry

    got = {r["n_reg"]: (r["mean"], r["std"]) for r in entry(spark).collect()}
    assert got == {
        0: (0.029412, 0.050943), 1: (0.153008, 0.032349), 2: (0.221205, 0.069913), 3: (0.263105, 0.086992),
        4: (0.33327, 0.064869),
    }


def test_no_shuffle_from_parse_to_features(spark, small, tmp_path):
    mapped = segments.map_segments(S.annotated(spark, small), ["doc_id", "source"])
    S.parsed(mapped, ["doc_id", "source"]).write.parquet(str(tmp_path / "p"))
    docs = spark.read.parquet(str(tmp_path / "p"))
    vocabulary = features.collected_vocabulary(features.vocabulary_tags(features.segments_table(docs, ["doc_id"])))
    plan = features.extract(docs, vocabulary)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_parses_are_read_once(spark, tmp_path):
    """Vocabulary and table come from one pass over the parses."""
    log = str(tmp_path / "rows")

    def counted(batches):
        for batch in batches:
            with open(log, "a") as f:
                f.write("x" * len(batch))
            yield batch

    schema = f"doc_id string, source string, segments array<{PARSED_SEGMENT}>"
    token = {"id": 1, "text": "dogs", "lemma": "dog", "upos": "NOUN", "feats": "Number=Plur", "head": 0, "deprel": "root"}
    fields = ["id", "text", "lemma", "upos", "xpos", "feats", "head", "deprel", "start_char", "end_char"]
    token = tuple(token.get(f) for f in fields)
    rows = [(f"d{i}", "s", [("L", "t", ([("t", [token] * (1 + i % 3))],), None)]) for i in range(20)]
    parsed = spark.createDataFrame(rows, schema)
    ids = parsed.select("doc_id").mapInPandas(counted, "doc_id string")
    table = features.extract(parsed.join(ids, "doc_id"))
    assert table.count() == 20 and {"pos_noun", "dep_root", "morph_Number_Plur"} <= set(table.columns)
    assert {r["pos_noun"] for r in table.collect()} == {1000.0}
    with open(log) as f:
        assert len(f.read()) == 20


def test_tokens_stay_in_their_worker(spark, small):
    """Texts are parsed and counted in one pass, with the records that parses read from files give."""
    assert queries.tag_rates_long(spark, small)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    keys = ["doc_id", "source"]
    mapped = segments.map_segments(S.annotated(spark, small), keys)
    apart = features.recorded(features.segments_table(S.parsed(mapped, keys), keys), keys)
    found = features.recorded_texts(mapped, keys, S.parses_of)
    assert found.schema.simpleString() == apart.schema.simpleString()
    assert sorted(found.collect(), key=lambda r: r[:3]) == sorted(apart.collect(), key=lambda r: r[:3])


def test_texts_of_any_length_and_none(spark, monkeypatch):
    monkeypatch.setattr(parses, "PART_BYTES", 40)
    rows = [
        ("a", "s", [("A", "One two. Three"), (None, None), ("B", "")]),
        ("b", "s", None),
        ("c", "s", []),
        ("d", "s", [("A", "Ünï cödé x " * 30), ("Cannot rate", "Word")]),
        (None, None, [("A", ".")]),
    ]
    mapped = spark.createDataFrame(rows, "doc_id string, source string, segments array<struct<label:string,text:string>>")
    keys = ["doc_id", "source"]
    apart = features.recorded(features.segments_table(S.parsed(mapped.coalesce(1), keys), keys), keys).collect()
    found = features.recorded_texts(mapped.coalesce(1), keys, S.parses_of).collect()
    assert found == apart and len(found) == 6


def test_wide_table_of_blocks(spark, small, tmp_path):
    """The wide table made in the workers is the one made of records, with excluded and short segments left out."""
    mapped = segments.map_segments(S.annotated(spark, small), ["doc_id", "source"])
    S.parsed(mapped, ["doc_id", "source"]).write.parquet(str(tmp_path / "p"))
    for least in (0, 12):
        want = features.extract(spark.read.parquet(str(tmp_path / "p")), min_tokens=least)
        got = features.extract_texts(mapped, S.parses_of, min_tokens=least)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert sorted(got.collect(), key=lambda r: r[:3]) == sorted(want.collect(), key=lambda r: r[:3])
    chosen = ["upos\tNOUN", "upos\tnoun", "feats\tX=Y"]
    want = features.extract(spark.read.parquet(str(tmp_path / "p")), chosen)
    assert sorted(features.extract_texts(mapped, S.parses_of, chosen).collect(), key=lambda r: r[:3]) == sorted(want.collect(), key=lambda r: r[:3])


def test_screening_reads_blocks(spark, small, monkeypatch):
    """Moments are taken where blocks are widened: the wide table is not written, and the results are those of the table."""
    table = features.widened_texts(segments.map_segments(S.annotated(spark, small), ["doc_id", "source"]), S.parses_of)
    want = multivariate.screen(table.data)

    def refused(df, path=None):
        raise AssertionError("the wide table is written")

    monkeypatch.setattr(multivariate, "materialise", refused)
    got = multivariate.screen(table)
    assert got.kept == want.kept and got.moments.n == want.moments.n
    assert [f for f, _ in got.report] == [f for f, _ in want.report]
    for part in ("mean", "std", "corr"):
        assert np.allclose(getattr(got.moments, part), getattr(want.moments, part), rtol=1e-12, atol=1e-12)
    assert sorted(got.data.collect(), key=lambda r: r[:3]) == sorted(want.data.collect(), key=lambda r: r[:3])
