"""Vectorised records of parses against plain code, and plans of the queries over them."""

import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from registrum.functions import parses
from registrum.functions import text as T
from registrum.operators import features
from registrum.plans import queries, standins
from registrum.schemas import PARSED_SEGMENT

FIELDS = ["id", "text", "lemma", "upos", "xpos", "feats", "head", "deprel", "start_char", "end_char"]


def token(i, text, upos="NOUN", lemma=None, feats=None, head=None, deprel="x"):
    got = {"id": i, "text": text, "lemma": lemma, "upos": upos, "feats": feats, "head": i and i - 1 if head is None else head, "deprel": deprel}
    return tuple(got.get(f) for f in FIELDS)


def plain_ttr(words, window):
    if len(words) < window:
        return len(set(words)) / len(words) if words else 0.0
    spans = [words[i : i + window] for i in range(len(words) - window + 1)]
    return sum(len(set(s)) / window for s in spans) / len(spans)


def test_records_of_odd_parses(spark):
    words = ["Äpfel", "äpfel", "ÄPFEL", "a", "İ", "x"] * 30
    long = [token(i + 1, w, lemma=w if i % 3 else "", feats="A=b|A=b|odd|C=d=e" if i % 5 == 0 else None) for i, w in enumerate(words)]
    segs = [
        ("L", "", None, None),
        ("L", "", ([],), None),
        ("L", "", ([("", None), ("", [])],), None),
        ("Cannot rate", "", ([("", [token(1, "t", "INTJ")])],), None),
        ("L", "", ([("", [token(1, "!", "PUNCT")])],), None),
        ("L", "", ([("", long), ("", [token(1, "!", "PUNCT"), token(None, None, None, deprel="", head=3)])],), None),
    ]
    docs = spark.createDataFrame([("d", "s", segs)], f"doc_id string, source string, segments array<{PARSED_SEGMENT}>")
    keys = ["doc_id", "source"]
    rows = features.recorded(features.segments_table(docs, keys), keys).orderBy("segment_idx").collect()
    assert [r["kept"] for r in rows] == [False] * 5 + [True]
    assert rows[0]["n_tokens"] is None and [r["n_tokens"] for r in rows[1:]] == [0, 0, 1, 0, 181]
    assert rows[3]["tags"] == ["deprel\tx", "upos\tINTJ"] and rows[3]["counts"] is None
    got = rows[5]
    assert {c["value"]: c["n"] for c in got["counts"]} == {
        "deprel\tx": 181, "feats\tA=b": 72, "feats\tC=d=e": 36, "upos\tNOUN": 180, "upos\tPUNCT": 1, "upos\tX": 1
    }
    assert [c["value"] for c in got["counts"]] == sorted(c["value"] for c in got["counts"]) and "upos\tX" not in got["tags"]
    lower = [w.lower() for w in words]
    want = {"mean_sent_len": 181 / 2, "mean_dep_dist": 1.0, "mean_word_len": sum(map(len, words)) / 180, "mattr50_words": plain_ttr(lower, 50)}
    assert all(math.isclose(got["means"][k], v, rel_tol=1e-12) for k, v in want.items())
    assert math.isclose(got["means"]["mattr50_lemmas"], want["mattr50_words"], rel_tol=1e-12)


def test_parts_do_not_change_records(spark, monkeypatch):
    texts = pa.array(["One two. Three four five.", "", None, "Vier  fünf. . sechs", "a b c d e f g"])
    whole = standins.parses_of(texts).field("sentences")
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), whole], names=["n", "sentences"])
    monkeypatch.setattr(parses, "PART_TOKENS", 5)
    cut = [parses.records_of(p.column(1), 50) for p in parses.parts(batch, "sentences")]
    assert len(cut) > 1
    for name, values in parses.records_of(whole, 50).items():
        assert [x for c in cut for x in c[name].to_pylist()] == values.to_pylist()


@pytest.mark.parametrize("name", ["tag_rates_long", "structural_means", "morphology_pairs"])
def test_tokens_are_not_interpreted(spark, small, name):
    """Words are cut, tagged and counted in Arrow batches; expressions over each token took most of the time."""
    plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "upos" not in plan.replace("upos:", "")


def test_structural_lines_are_told_by_their_beginning(spark):
    """As stripping the whole line and looking at its prefix, without a pass over the line."""
    ends = ["", " ", "\n", " ", "\x1c", " x", "x", " x \n", "é"]
    texts = [a + b + c for a in ["", " ", "\x1f　", "\n", "y "] for b in ["# ", "#", "TABLE: ", "TABLE:", "CODE: ", "# ", ""] for c in ends]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    bare = T.strip(F.col("t"))
    stripped = bare.startswith("# ") | bare.startswith("TABLE: ") | bare.startswith("CODE: ")
    found = df.select(T.is_structural(F.col("t")).alias("got"), stripped.alias("want"))
    assert found.where("NOT got <=> want").count() == 0
    assert "regexp_replace" not in df.select(T.is_structural(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_tags_are_counted_from_distinct_values(monkeypatch):
    """What is added up by tag is a segment's distinct values, not its tokens, and lemmas that are the words are not sorted again."""
    seen, sorted_ = [], []
    lists, ttr = parses._tag_lists, parses.moving_ttr
    monkeypatch.setattr(parses, "_tag_lists", lambda owner, *rest: seen.append(len(owner)) or lists(owner, *rest))
    monkeypatch.setattr(parses, "moving_ttr", lambda *args: sorted_.append(1) or ttr(*args))
    found = parses.records_of(standins.parses_of(pa.array(["ab cde " * 500, "ab. " * 300])).field("sentences"), 50)
    assert found["n_tokens"].to_pylist() == [1000, 300]
    assert max(seen) < 60 and len(sorted_) == 1


def test_lower_case_of_any_script():
    texts = ["ÄÖ", "abC", "", None, "İx", "ȺZ", "ΑΣ", "ß", "Ɏ", "“A”", "𐐀"]
    assert parses.lowered(pa.array(texts)).to_pylist() == [t and t.lower() for t in texts]
    assert parses.lowered(pa.array(texts).slice(1, 3)).to_pylist() == ["abc", "", None]


def test_numbered_lines_without_patterns_over_the_line(spark):
    lines = ["[1] a", "[2]\t b ", "[3]", "[4]  \x1c c", "[05] [6] d]", "[7", "7] e", "[] f", "[8x] g", "[99999999999] h", " [9] i", "[9] ", "[10]é"]
    df = spark.createDataFrame([("\n".join(lines),), (None,)], "t string").select(T.parse_numbered(F.col("t")).alias("x"))
    assert [[tuple(r) for r in x[0]] for x in df.collect()] == [
        [(1, "a"), (2, "b "), (3, ""), (4, "c"), (5, "[6] d]"), (None, "h"), (9, ""), (10, "é")], []
    ]
    assert "regexp_extract" not in df._jdf.queryExecution().optimizedPlan().toString()
