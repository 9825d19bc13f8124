"""Quality rules as a ledger of failure bits, and policies as masks over it.

Every rule is evaluated once per document. The ledger keeps what was measured and
one ``long`` whose bit *b* says that rule *b* failed. A policy is a version name
and a mask of the rules that count, so applying a policy, comparing versions and
finding what each rule contributes need no text: they are ``&`` on the ledger and
sums over its distinct bit patterns.

Defined cases: a null or empty text has no words, all measures are 0 and the rule
on the number of words fails. Very long texts are worked off one at a time. Ties do not
arise, no rule compares documents. Repeated rows and ids are judged row by row. Columns
other than ``doc_id`` and ``text`` are not read. An empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registrum.llm.common import BLANKS, only, shared_folder, slices, texts_of, written

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_echo_words", "n_upper", "n_lower")
LEDGER_SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails``, SQL over the measures in whole numbers, is true."""

    bit: int
    name: str
    fails: str


#: Bits are never given to another rule: old ledgers stay readable.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
    Rule(6, "shouting", "n_upper > n_lower AND n_upper > 20"),
    Rule(7, "stutter", "100 * n_echo_words > 30 * n_words"),
)
BASE = 0b0000011
POLICIES: Mapping[str, int] = {"base": BASE, "v1": BASE | 0b0001100, "v2": BASE | 0b11111100}
PRODUCTION = "v2"


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more in the text, first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    code, size, width = ids, len(numbers), 1
    while width < window:
        if size * len(numbers) >= 1 << 62:  # the next product would not fit: number the windows so far afresh
            kinds, code = np.unique(code, return_inverse=True)
            size = len(kinds)
        code = code[: len(words) - width] * len(numbers) + ids[width:]
        size *= len(numbers)
        width += 1
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += again
    edge[window:] -= again
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measures(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at ASCII white space only
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - (len(raw) - len(raw.translate(None, BLANKS))),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(words),
        sum(map(bytes.__eq__, words, words[1:])),
        len(raw) - len(raw.translate(None, UPPER)),
        len(raw) - len(raw.translate(None, LOWER)),
    )


def measured(docs: DataFrame) -> DataFrame:
    """One row per document with all measures; one pass over the text, no shuffle."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows, "text"):
            found = [measures(t) for t in texts_of(batch.column("text"))]
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], ["doc_id", *MEASURES])

    return only(docs, "doc_id", "text").mapInArrow(run, LEDGER_SCHEMA)


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures and ``fail_bits`` of every document."""
    if len({r.bit for r in rules}) != len(rules) or any(not 0 <= r.bit < 63 for r in rules):
        raise ValueError("each rule needs a bit of its own from 0 to 62")
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured(docs).withColumn("fail_bits", bits)


def stored(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger, written to the shared folder and read from there: policies and ablations never see a text."""
    return written(ledger(docs, rules), f"{shared_folder(docs.sparkSession)}/ledger")


def apply_policy(book: DataFrame, mask: int, column: str = "kept") -> DataFrame:
    """Add ``column``: none of the policy's rules failed."""
    return book.withColumn(column, F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) == 0)


def ablations(book: DataFrame, policies: Mapping[str, int] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What each rule does in each policy.

    Documents are first counted per distinct ``fail_bits`` (at most 2 to the number
    of rules, far fewer in practice), and everything else is bitwise arithmetic over
    those counts. Per (policy, rule): ``failed`` documents, ``alone`` (it is the only
    failing rule of the policy: dropping it would keep them), ``kept`` by the policy,
    ``kept_without`` the rule.
    """
    patterns = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    cells = [
        F.struct(F.lit(version).alias("policy"), F.lit(r.name).alias("rule"), F.lit(mask).cast("long").alias("mask"), F.lit(1 << r.bit).cast("long").alias("bit"))
        for version, mask in policies.items()
        for r in rules
        if mask >> r.bit & 1
    ]
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    count = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0))
    return (
        patterns.select("fail_bits", "n", F.inline(F.array(*cells)))
        .groupBy("policy", "rule")
        .agg(
            count(hit.bitwiseAND(F.col("bit")) != 0).alias("failed"),
            count(hit == F.col("bit")).alias("alone"),
            count(hit == 0).alias("kept"),
            count(hit.bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without"),
        )
    )
