"""Plain-text evaluation reports from the few counted cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registrum.operators import evaluation
from registrum.schemas import FACETS


def _table(report: list, averages, accuracy: float, n: int) -> list[str]:
    width = max([len(r["label"]) for r in report] + [len("weighted avg")])
    lines = [f"{'':>{width}}  {'precision':>9} {'recall':>9} {'f1-score':>9} {'support':>9}", ""]
    for r in sorted(report, key=lambda r: r["label"]):
        lines.append(
            f"{r['label']:>{width}}  {r['precision']:>9.2f} {r['recall']:>9.2f} {r['f1']:>9.2f} {r['support']:>9}"
        )
    lines += ["", f"{'accuracy':>{width}}  {'':>9} {'':>9} {accuracy:>9.2f} {n:>9}"]
    for kind in ("macro", "weighted"):
        p, r, f = (averages[f"{kind}_{m}"] for m in ("precision", "recall", "f1"))
        lines.append(f"{kind + ' avg':>{width}}  {p:>9.2f} {r:>9.2f} {f:>9.2f} {n:>9}")
    return lines


def _sections(cells: DataFrame) -> list[str]:
    """Accuracy, class table and matrix of each facet, then of the derived register."""
    by = ["facet"]
    report = evaluation.class_report(cells, by)
    rows: dict[str, list] = {}
    for r in report.collect():
        rows.setdefault(r["facet"], []).append(r)
    averages = {r["facet"]: r for r in evaluation.report_averages(report, by).collect()}
    accuracy = {r["facet"]: r for r in evaluation.accuracy(cells, by).collect()}
    matrices = {
        r["facet"]: r["text"] for r in evaluation.matrix_text(evaluation.confusion_matrix(cells, by), by).collect()
    }
    lines = []
    for facet in [*FACETS, evaluation.REGISTER]:
        title = "derived register" if facet == evaluation.REGISTER else facet
        if facet not in rows:
            lines += ["", f"--- {title}: no valid pairs ---", ""]
            continue
        n, acc = accuracy[facet]["n"], accuracy[facet]["accuracy"]
        lines += ["", f"--- {title} (n={n}, accuracy={acc:.3f}) ---"]
        lines += _table(rows[facet], averages[facet], acc, n)
        lines += ["", "Confusion matrix (rows: human, columns: model):", matrices[facet], ""]
    return lines


def language_report(cells: DataFrame, lang: str, truncate: bool = False) -> str:
    own = cells.where(F.col("lang") == lang)
    overall = evaluation.overall_accuracy(own, truncate).first()
    lines = [f"LANGUAGE: {lang}"] + _sections(own)
    if overall:
        lines.append(f"Overall accuracy, four facets pooled: {overall['accuracy']:.3f} (n={overall['n']})")
    return "\n".join(lines)


def pooled_report(cells: DataFrame, truncate: bool = False) -> str:
    lines = [f"POOLED ACROSS LANGUAGES ({cells.select('lang').distinct().count()})"]
    for r in evaluation.pooled_accuracy(cells, truncate).orderBy(F.col("measure").desc()).collect():
        lines.append(f"Mean {r['measure']} accuracy: {r['mean']:.3f} (std={r['std']:.3f})")
    return "\n".join(lines + _sections(cells))


def all_reports(cells: DataFrame, truncate: bool = False) -> dict[str, str]:
    """Reports by name: one per language, ``pooled``, and ``full`` with all of them."""
    langs = sorted(r["lang"] for r in cells.select("lang").distinct().collect())
    out = {lang: language_report(cells, lang, truncate) for lang in langs}
    out["pooled"] = pooled_report(cells, truncate)
    out["full"] = "\n\n".join(out.values())
    return out
