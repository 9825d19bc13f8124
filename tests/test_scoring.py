"""Metrics against published confusion matrices, and agreement against brute force."""

import pytest
from pyspark.sql import functions as F

from registrum.operators import compare, evaluation, reports
from registrum.plans import standins as S


def cells(spark, table, facet="mode_medium", lang="xx"):
    rows = [(lang, facet, t, p, n) for (t, p), n in table.items() if n]
    return spark.createDataFrame(rows, "lang string, facet string, truth string, pred string, n bigint")


def plain(table):
    labels = sorted({x for k, n in table.items() if n for x in k})
    out = {}
    for c in labels:
        hit = table.get((c, c), 0)
        pred = sum(n for (t, p), n in table.items() if p == c)
        sup = sum(n for (t, p), n in table.items() if t == c)
        p, r = (hit / pred if pred else 0.0), (hit / sup if sup else 0.0)
        out[c] = (p, r, 2 * p * r / (p + r) if p + r else 0.0, sup)
    return out


TABLES = [
    {("a", "a"): 15, ("a", "b"): 7},
    {("a", "a"): 3, ("a", "b"): 1, ("b", "a"): 2, ("b", "b"): 9, ("c", "b"): 4},
    {("a", "b"): 5, ("b", "a"): 5},
    {("x", "x"): 10},
]


@pytest.mark.parametrize("table", TABLES)
def test_class_report(spark, table):
    report = evaluation.class_report(cells(spark, table), ["facet"])
    got = {r["label"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in report.collect()}
    want = plain(table)
    assert set(got) == set(want)
    for c in want:
        assert got[c] == pytest.approx(want[c])
    avg = evaluation.report_averages(report, ["facet"]).first()
    assert avg["macro_f1"] == pytest.approx(sum(v[2] for v in want.values()) / len(want))
    n = sum(v[3] for v in want.values())
    assert avg["weighted_recall"] == pytest.approx(sum(v[1] * v[3] for v in want.values()) / n)


def test_truncated_accuracy_loses_one(spark):
    c = cells(spark, TABLES[0])
    assert evaluation.overall_accuracy(c).first()["accuracy"] == pytest.approx(15 / 22)
    assert evaluation.overall_accuracy(c, truncate=True).first()["accuracy"] == pytest.approx(14 / 22)


# A published pooled matrix for the medium facet (rows: human, columns: model) and its printed figures.
MEDIUM = {
    ("cannot_rate", "cannot_rate"): 153, ("cannot_rate", "transcribed"): 0, ("cannot_rate", "written"): 85,
    ("transcribed", "cannot_rate"): 0, ("transcribed", "transcribed"): 13, ("transcribed", "written"): 6,
    ("written", "cannot_rate"): 3, ("written", "transcribed"): 4, ("written", "written"): 586,
}
MEDIUM_FIGURES = {
    "cannot_rate": ("0.98", "0.64", "0.78", 238),
    "transcribed": ("0.76", "0.68", "0.72", 19),
    "written": ("0.87", "0.99", "0.92", 593),
}
MEDIUM_AVERAGES = {"macro": ("0.87", "0.77", "0.81"), "weighted": ("0.90", "0.88", "0.88")}
# Published hits and pairs per facet of one language, and its overall accuracy, cut and exact.
FACET_HITS = {
    "mode_medium": (214, 250), "mode_turn": (153, 159), "field_activity": (119, 159), "tenor_formality": (149, 159),
}


def test_published_figures(spark):
    c = cells(spark, MEDIUM)
    report = evaluation.class_report(c, ["facet"])
    shown = {
        r["label"]: (f"{r['precision']:.2f}", f"{r['recall']:.2f}", f"{r['f1']:.2f}", r["support"]) for r in report.collect()
    }
    assert shown == MEDIUM_FIGURES
    averages = evaluation.report_averages(report, ["facet"]).first()
    for kind, figures in MEDIUM_AVERAGES.items():
        assert tuple(f"{averages[f'{kind}_{m}']:.2f}" for m in ("precision", "recall", "f1")) == figures
    row = evaluation.accuracy(c, ["facet"]).first()
    assert (row["correct"], row["n"], f"{row['accuracy']:.3f}") == (752, 850, "0.885")


def test_published_overall_accuracy_lost_one_hit(spark):
    rows = []
    for facet, (hits, n) in FACET_HITS.items():
        rows += [("xx", facet, "a", "a", hits), ("xx", facet, "a", "b", n - hits)]
    c = spark.createDataFrame(rows, "lang string, facet string, truth string, pred string, n bigint")
    assert f"{evaluation.overall_accuracy(c, truncate=True).first()['accuracy']:.3f}" == "0.872"
    assert f"{evaluation.overall_accuracy(c).first()['accuracy']:.3f}" == "0.873"


def test_matrix_and_reports(spark):
    c = cells(spark, TABLES[1])
    grid = {(r["truth"], r["pred"]): r["n"] for r in evaluation.confusion_matrix(c, ["facet"]).collect()}
    assert len(grid) == 9 and grid[("c", "c")] == 0 and grid[("c", "b")] == 4
    texts = reports.all_reports(c.unionByName(cells(spark, TABLES[3], lang="yy")))
    assert set(texts) == {"xx", "yy", "pooled", "full"}
    assert "accuracy=0.632" in texts["xx"] and "mode_turn: no valid pairs" in texts["xx"]


def test_compare_null_safe_and_last_wins(spark):
    ann = lambda *rows: [(n, m, None, None, None, None) for n, m in rows]
    schema = (
        "doc_id int, u string, markdown_main string, markdown_comments string, "
        "llm_register_annotation struct<main:array<struct<line:int,mode_medium:string,mode_turn:string,"
        "field_activity:string,tenor_formality:string,is_structural:boolean>>,comments:array<struct<line:int,"
        "mode_medium:string,mode_turn:string,field_activity:string,tenor_formality:string,is_structural:boolean>>>, "
        "classification_failed boolean"
    )
    left = spark.createDataFrame(
        [
            (0, "a", "[1] old", "", (ann((1, "x")), []), None),
            (1, "a", "[1] new\n[2] two", "", (ann((1, "written"), (2, "z"), (2, "written")), []), None),
            (2, "", "[1] n", "", (ann((1, "written")), []), None),
            (3, "c", "[1] n", "", (ann((1, "written")), []), True),
        ],
        schema,
    )
    right = spark.createDataFrame(
        [
            (0, "a", "", "", (ann((2, "cannot_rate"), (1, "written"), (9, "q")), []), False),
            (1, "c", "", "", (ann((1, "written")), []), False),
            (2, "d", "", "", (ann((1, "written")), []), False),
        ],
        schema,
    )
    assert tuple(compare.match_counts(left, right).first()) == (2, 0, 1)
    pairs = compare.matched(left, right, with_text=True)
    assert tuple(compare.summary(pairs).first()) == (2, 1, 0, 2)
    agreement = {r["field"]: (r["agree"], r["disagree"]) for r in compare.facet_agreement(compare.cells(compare.compared_lines(pairs))).collect()}
    assert agreement == {"mode_medium": (1, 1), "mode_turn": (2, 0), "field_activity": (2, 0), "tenor_formality": (2, 0)}
    example = compare.examples(compare.disagreement_lines(pairs)).collect()
    assert [(r["u"], r["line"], r["text"]) for r in example] == [("a", 2, "two")]


def test_partitioning_does_not_matter(spark, small):
    rated = S.rated_lines(spark, small)
    shapes = [evaluation.confusion_cells(d) for d in (rated.coalesce(1), rated.repartition(7))]
    a, b = ({tuple(r) for r in s.collect()} for s in shapes)
    assert a == b and sum(r[-1] for r in a) > 5000


def test_caps_are_an_argument(spark):
    tasks = spark.range(700).select((F.col("id") % 2).cast("string").alias("lang"), "id")

    def counts(**caps):
        return {r["lang"]: r["count"] for r in evaluation.first_tasks(tasks, "lang", ["id"], **caps).groupBy("lang").count().collect()}

    assert counts() == {"0": 250, "1": 250}
    assert counts(caps=F.when(F.col("lang") == "0", 300).otherwise(7)) == {"0": 300, "1": 7}
    assert counts(caps=F.lit(20), largest=20) == {"0": 20, "1": 20}
