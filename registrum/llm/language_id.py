"""Language identification with n-gram filters whose slots hold a bit per language.

Learning counts letter trigrams (word edges included) per language over all training
texts. A language's filter holds the trigrams that make up at least ``MIN_SHARE`` of
its own trigrams, and at least ``MIN_RATIO`` of the share they reach in any language;
so it has at most ``1 / MIN_SHARE`` members however much text there is, which bounds
what reaches the driver and what is sent to the tasks. All languages share one Bloom
filter: a slot is a word of bits, one bit per language, and the ``and`` of an n-gram's
slots gives at once all languages that contain it (with false positives).

Prediction counts, per language, how many of the text's trigrams have its bit. With
``f`` the chance that a foreign trigram passes (known from how full the language's
bits are), a fraction ``x`` of hits estimates ``(x - f) / (1 - f)`` of real members.
The language with the largest estimate wins, ties go to the earlier name.

Defined cases: a null text, or one without letters, is ``und`` with score and cover 0.
A text none of whose trigrams is known gets the commonest language with score 0. Rows
without a language do not teach. Repeated rows count as often as they occur. Without
any training row all texts are ``und``. Columns besides those named are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registrum.llm.common import only, slices, texts_of

MIN_SHARE, MIN_RATIO = 2e-5, 0.25
SLOTS, HASHES = 1 << 20, 4
UNKNOWN = "und"
#: Characters handled in one numpy step, which bounds a task's memory besides its longest text.
STEP = 1 << 19
_WIDTH = 21  # bits of a code point
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For every code point itself if it is a letter or a mark, else 0."""
    if not _letters:
        _letters.append(np.array([c if unicodedata.category(chr(c))[0] in "LM" else 0 for c in range(0x110000)], np.int64))
    return _letters[0]


def steps(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about STEP characters in all; a longer text comes alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > STEP:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t) + 3
    if at < len(texts):
        yield at, texts[at:]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All trigrams of the texts, and for each the number of its text.

    A trigram is three characters whose middle one is a letter; what is no letter counts as 0.
    """
    joined = "\0" + "\0\0".join(t.lower() for t in texts) + "\0"
    c = letter_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    middle = np.flatnonzero(c[1:-1]) + 1
    gram = (c[middle - 1] << 2 * _WIDTH) | (c[middle] << _WIDTH) | c[middle + 1]
    ends = np.cumsum([len(t.lower()) + 2 for t in texts])
    return gram, np.searchsorted(ends, middle, side="right")


def counted(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) summed over all rows with a language."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in slices(rows, "text"):
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:
                    by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                parts = sums.setdefault(lang, [])
                for _, some in steps(texts):
                    parts.append(np.unique(trigrams(some)[0], return_counts=True))
                    if len(parts) > 32:
                        parts[:] = [merged(parts)]
        for lang, parts in sums.items():
            gram, n = merged(parts)
            for i in range(0, len(gram), 1 << 16):
                g = gram[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g), pa.array(n[i : i + (1 << 16)])], ["lang", "gram", "n"])

    known = only(docs, "lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    return known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n = np.zeros(len(gram), np.int64)
    np.add.at(n, at, np.concatenate([p[1] for p in parts]))
    return gram, n


def spots(gram: np.ndarray) -> Iterator[np.ndarray]:
    """The HASHES slots of each n-gram."""
    h = gram.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    step = (h >> np.uint64(40)) | np.uint64(1)
    for _ in range(HASHES):
        yield (h & np.uint64(SLOTS - 1)).astype(np.int64)
        h = h + step


@dataclass
class Filters:
    """Bit-sliced filters: ``slots[w]`` holds languages 64 w to 64 w + 63."""

    languages: list[str]
    slots: np.ndarray
    chance: np.ndarray
    commonest: int
    #: Share of each language's own trigrams that its filter holds and that occur more than once: the cover of a text that did not teach.
    expected: dict[str, float]

    @classmethod
    def build(cls, members: dict[str, np.ndarray], weights: dict[str, int], expected: dict[str, float] | None = None) -> Filters:
        languages = sorted(members)
        slots = np.zeros(((len(languages) + 63) // 64, SLOTS), np.uint64)
        full = []
        for i, lang in enumerate(languages):
            bit = np.uint64(1 << i % 64)
            for at in spots(members[lang]):
                slots[i // 64, at] |= bit
            full.append(float((slots[i // 64] & bit != 0).mean()))
        if len(languages) <= 8:  # one byte a slot is enough
            slots = slots.astype(np.uint8)
        best = max(range(len(languages)), key=lambda i: (weights[languages[i]], -i)) if languages else 0
        return cls(languages, slots, np.array(full) ** HASHES, best, expected or dict.fromkeys(languages, 1.0))

    def containing(self, gram: np.ndarray) -> np.ndarray:
        """Per word of 64 languages, the bits of all languages that contain each n-gram."""
        out = None
        for at in spots(gram):
            found = self.slots[:, at]
            out = found if out is None else out & found
        return out

    def decide(self, texts: list[str]) -> Iterator[tuple[str, float, float]]:
        """(language, score, cover) of each text."""
        for _, some in steps(texts):
            gram, of = trigrams(some)
            n = np.bincount(of, minlength=len(some))
            bits = self.containing(gram) if self.languages else None
            share = np.zeros((len(self.languages), len(some)))
            for i in range(len(self.languages)):
                word = bits[i // 64]
                hit = (word >> word.dtype.type(i % 64)) & word.dtype.type(1)
                x = np.bincount(of, weights=hit, minlength=len(some)) / np.maximum(n, 1)
                share[i] = np.clip((x - self.chance[i]) / (1 - self.chance[i]), 0, 1)
            for k in range(len(some)):
                if not n[k] or not self.languages:
                    yield UNKNOWN, 0.0, 0.0
                    continue
                order = np.argsort(-share[:, k], kind="stable")
                first = share[order[0], k]
                second = share[order[1], k] if len(order) > 1 else 0.0
                if first == 0:
                    yield self.languages[self.commonest], 0.0, 0.0
                else:
                    yield self.languages[order[0]], float(first / (first + second)), float(first)


def learn(docs: DataFrame) -> Filters:
    """Filters from the texts of all rows whose ``lang`` is not null."""
    n = counted(docs)
    totals = {r["lang"]: r["n"] for r in n.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row per language
    if not totals:
        return Filters.build({}, {})
    total = F.element_at(F.create_map(*[F.lit(x) for pair in totals.items() for x in pair]), F.col("lang"))
    shares = n.withColumn("share", F.col("n") / total).where(F.col("share") >= MIN_SHARE)
    # A share of another language below MIN_SHARE can't be the largest, so what was cut above is not missed here.
    top = F.max("share").over(_window("gram"))
    members = shares.withColumn("top", top).where(F.col("share") >= MIN_RATIO * F.col("top")).select("lang", "gram", "share", "n")
    rows = members.toPandas()  # at most 1 / MIN_SHARE a language
    own = {lang: rows[rows["lang"] == lang] for lang in totals}
    return Filters.build({lang: x["gram"].to_numpy(np.int64) for lang, x in own.items()}, totals, {lang: float(x["share"][x["n"] > 1].sum()) for lang, x in own.items()})


def _window(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key)  # at most one row per language


def predict(docs: DataFrame, filters: Filters, *keep: Column) -> DataFrame:
    """``keep`` (columns of ``docs``), lang_pred, score and cover of every document."""
    frame = docs.select(*keep, F.col("text").alias("_text"))
    kept = frame.columns[:-1]
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # SLOTS words a 64 languages: bounded

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(rows, "_text"):
            lang, score, cover = zip(*model.decide(texts_of(batch.column("_text"))), strict=True)
            made = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(cover, pa.float64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], [*kept, "lang_pred", "score", "cover"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1])
    return frame.mapInArrow(run, f"{types}, lang_pred string, score double, cover double")
