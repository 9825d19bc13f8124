"""Text, array and annotation expressions against small golden cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from registrum.functions import annotation as A
from registrum.functions import arrays, names
from registrum.functions import text as T
from registrum.schemas import ANNOTATION, LINE
from registrum.sources import sessions


def one(spark, value, ddl, make):
    return spark.createDataFrame([(value,)], f"x {ddl}").select(make(F.col("x")).alias("y")).first()["y"]


def test_parse_numbered(spark):
    rows = one(spark, "[1] # h\nbad\n[2]  x\n[3]", "string", T.parse_numbered)
    assert [(r["num"], r["text"]) for r in rows] == [(1, "# h"), (2, "x"), (3, "")]
    assert one(spark, None, "string", T.parse_numbered) == []
    assert one(spark, "[7]　a b", "string", T.parse_numbered)[0]["text"] == "a b"


def test_whitespace(spark):
    raw = "　 a \tb\x1c\nc  "
    assert one(spark, raw, "string", T.collapse_whitespace) == "a b c"
    assert one(spark, None, "string", T.collapse_whitespace) == ""
    assert one(spark, "a <\n\t\"b\"&'", "string", T.clean_markup_text) == "a &lt; &quot;b&quot;&amp;&#x27;"


@pytest.mark.parametrize(
    "text, expected",
    [("  # h", True), ("TABLE: x", True), ("CODE: y", True), ("#h", False), ("> CODE: ", False), ("　# x", True)],
)
def test_structural(spark, text, expected):
    assert one(spark, text, "string", T.is_structural) is expected


def test_truncate(spark):
    assert one(spark, "abcd", "string", lambda c: T.truncate(c, 3)) == "abc..."
    assert one(spark, "abc", "string", lambda c: T.truncate(c, 3)) == "abc"
    for text in ["a😀b", "ab", "😀😀", "ab😀"]:
        units = text.encode("utf-16-le")
        got = one(spark, text, "string", lambda c: T.truncate_utf16(c, 3))
        assert got == (text if len(units) <= 6 else units[:6].decode("utf-16-le", "ignore") + "…")


def test_feats_and_names(spark):
    pairs = one(spark, "A=1|junk|B=2=3|A=1", "string", T.parse_feats)
    assert [tuple(p) for p in pairs] == [("A", "1"), ("B", "2=3"), ("A", "1")]
    assert one(spark, None, "string", T.parse_feats) == []
    assert one(spark, "nmod:poss", "string", lambda c: T.safe_name("dep", c)) == "dep_nmod_poss"
    assert one(spark, "F12", "string", T.display_factor) == "Dimension 12"
    assert one(spark, "Fx", "string", T.display_factor) == "Fx"


def test_file_names(spark):
    path = "/d/cmn_Hant_parsed.jsonl"
    assert one(spark, path, "string", names.merge_group) == "cmn"
    assert one(spark, path, "string", names.source_tag) == "cmn_Hant"
    assert one(spark, "/d/FIN_latn_annotated.jsonl", "string", names.parser_code) == "fi"
    assert one(spark, "/d/xyz.jsonl", "string", names.parser_code) is None
    assert one(spark, "/d/cmn_parsed.jsonl", "string", names.merge_group) == "cmn"
    assert one(spark, "/d/pes_Arab_annotated.jsonl", "string", names.display_language) == "Persian"
    assert names.language_styles(["cmn", "x", "y"])[1:] == [("x", "#469990", "x"), ("y", "#800000", "y")]


def plain_mattr(tokens, window):
    n = len(tokens)
    if n < window:
        return len(set(tokens)) / n if n else 0.0
    spans = [len(set(tokens[i : i + window])) / window for i in range(n - window + 1)]
    return sum(spans) / len(spans)


def test_moving_ttr(spark):
    rng = random.Random(1)
    lists = [[], list("abacabb"), ["x"], ["x"] * 9]
    lists += [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))] for _ in range(30)]
    df = spark.createDataFrame([(x,) for x in lists], "x array<string>").select(
        "x", arrays.moving_ttr(F.col("x"), 3).alias("m3"), arrays.moving_ttr(F.col("x"), 50).alias("m50")
    )
    for row in df.collect():
        assert row["m3"] == pytest.approx(plain_mattr(row["x"], 3), abs=1e-12)
        assert row["m50"] == pytest.approx(plain_mattr(row["x"], 50), abs=1e-12)


def test_lookup_matches_dictionary(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(60):
        nums = [rng.randint(1, 6) for _ in range(rng.randint(0, 7))]
        anns = [(rng.choice([None, 1, 2, 3, 4, 5, 6]), f"m{i}") for i in range(rng.randint(0, 7))]
        rows.append((nums, anns))
    rows += [([1, 2, 3], [(1, "a"), (2, "b"), (3, "c")]), ([1, 1], [(1, "a"), (1, "b")])]
    data = [
        ([(n, f"t{n}") for n in nums], [(line, m, None, None, None, None) for line, m in anns]) for nums, anns in rows
    ]
    df = spark.createDataFrame(data, f"l array<{LINE}>, a array<{ANNOTATION}>")
    joined = arrays.lookup(
        F.col("l"), lambda l: l["num"], F.col("a"), lambda a: a["line"],
        lambda l, a: F.struct(l["num"].alias("num"), a["mode_medium"].alias("m")), ANNOTATION, LINE,
    )
    for (nums, anns), row in zip(rows, df.select(joined.alias("j")).collect()):
        last = {line: m for line, m in anns if line is not None}
        assert [(x["num"], x["m"]) for x in row["j"]] == [(n, last.get(n)) for n in nums]


def test_counts(spark):
    got = one(spark, ["b", "a", "b", "z"], "array<string>",
              lambda c: arrays.align_counts(arrays.run_lengths(c), F.array(F.lit("a"), F.lit("b"), F.lit("c"))))
    assert got == [1, 2, 0]
    assert [tuple(r) for r in one(spark, ["b", "a", "b"], "array<string>", arrays.run_lengths)] == [("a", 1), ("b", 2)]


def annotation(spark, facets, make, line=1):
    df = spark.createDataFrame([((line, *facets, None),)], f"x {ANNOTATION}")
    return df.select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "given, expected",
    [
        (("spoken", "dialogic", "creating", "informal"), ("cannot_rate", None, None, None)),
        (("written", None, None, None), ("written", "monologic", "explaining", "formal")),
        (("written", "both", "news", "casual"), ("written", "monologic", "explaining", "formal")),
        (("cannot_rate", "dialogic", "creating", "formal"), ("cannot_rate", None, None, None)),
        (("transcribed", "dialogic", "evaluating", "informal"), ("transcribed", "dialogic", "evaluating", "informal")),
        ((None, None, None, None), ("cannot_rate", None, None, None)),
    ],
)
def test_validate(spark, given, expected):
    assert tuple(annotation(spark, given, A.validate))[1:5] == expected


@pytest.mark.parametrize(
    "facets, short, long",
    [
        (("cannot_rate", None, None), "Cannot rate", "Cannot rate"),
        (("transcribed", "dialogic", "creating"), "Spoken", "Spoken"),
        (("written", "dialogic", "promoting"), "Interactive Discussion", "Interactive Discussion"),
        (("written", "monologic", "promoting"), "Info. persuasion", "Informational Persuasion"),
        (("written", "monologic", "explaining"), "Info. description/explanation", "Informational Description"),
        (("written", "monologic", "directing"), "How-to/instruct.", "How-to or Instructional"),
        (("written", "monologic", None), None, "Cannot rate"),
        ((None, "dialogic", None), "Interactive Discussion", "Interactive Discussion"),
    ],
)
def test_registers(spark, facets, short, long):
    df = spark.createDataFrame([facets], "m string, t string, a string")
    row = df.select(
        A.register_for_scoring(F.col("m"), F.col("t"), F.col("a")).alias("s"),
        A.register_for_segments(F.col("m"), F.col("t"), F.col("a")).alias("l"),
    ).first()
    assert tuple(row) == (short, long)


@pytest.mark.parametrize(
    "raw, status, numbers",
    [
        ('```json\n[{"line":1}]\n```', "ok", [1]),
        ('Sure: [{"line":1}] hope that helps', "ok", [1]),
        ('[{"line":1},{"line":2,"mo', "ok", [1]),
        ('<think>[x]\n</think>[{"line":1}]', "ok", [1]),
        ('{"line":1}', "unparsed", None),
        ("[]", "ok", []),
        ("[1, 2]", "broken", None),
        ('{"items":[{"line":1}]}', "broken", None),
        ('[{"line":1}] see {x}', "unparsed", None),
        ('[{"line":"3"},{"line":4.0,"mode_medium":5}]', "ok", [None, 4]),
    ],
)
def test_decode_response(spark, raw, status, numbers):
    got = one(spark, raw, "string", A.decode_response)
    assert got["status"] == status
    assert (got["items"] and [i["line"] for i in got["items"]]) == (numbers or (got["items"] and None))


def test_keys_and_filters(spark):
    ann = ("written", "monologic", "creating", "formal")
    assert annotation(spark, ann, A.label_key) == "written|creating"
    assert annotation(spark, ("cannot_rate", None, None, None), A.label_key) == "cannot_rate|_"
    assert annotation(spark, ("written", None, None, None), A.label_key) == "written|none"
    assert annotation(spark, ann, A.describe) == "creating | written | monologic | formal"
    assert annotation(spark, ann, lambda a: A.any_facet_is(a, "formal")) is True
    assert annotation(spark, ann, lambda a: A.any_facet_is(a, "x")) is False
    assert annotation(spark, ("structural", None, None, None), A.is_reviewable) is False
    missing = spark.createDataFrame([(None,)], f"x {ANNOTATION}")
    row = missing.select(
        A.label_key(F.col("x")), A.stratum_key(F.col("x")), A.describe(F.col("x")), A.any_facet_is(F.col("x"), "a")
    ).first()
    assert tuple(row) == ("no_ann", "no_ann|none", "(no annotation)", False)


def plain_fingerprint(text):
    units = text.encode("utf-16-le", "surrogatepass")
    h = 5381
    for i in range(0, len(units), 2):
        h = (h * 33 + units[i] + 256 * units[i + 1]) % 2**32
    return f"{sessions._base36(len(units) // 2)}_{sessions._base36(h)}"


def test_fingerprint(spark):
    texts = ["", "a", "héllo 😀 " * 50 + "x", "日本語\n"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [r[0] for r in df.select(sessions.fingerprint(F.col("x"))).collect()]
    assert got == [plain_fingerprint(t.strip()) for t in texts]
