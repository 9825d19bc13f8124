"""Spelling variants: words one edit apart, found with a bit-sliced position index.

Words. Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, only A-Z lower-cased, are counted over all
texts. A crc32 of document and run picks one run in ``SLIP`` and takes one code point out of
it. Words have at least ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences.

Meeting. Cut the shorter of two near words in the middle: the edit spares one half, so both
begin or both end with the same ``length // 2`` letters. A word of length m is dealt to four
groups: by beginning and by end, once as a word of length m and once as the longer partner
of words of length m - 1. Groups of one word are dropped; large ones are split into parts of
which every two, and each with itself, meet in one group.

Index. The words of a group (small groups are packed together) are rows of bitsets, one for
each position and letter. For all words of a group's shorter length at once, the recurrence
goes through the letters of the word and keeps, as bitsets over the group, the rows that
agree so far (zero errors), the rows with one letter replaced so far, and the rows that have
one letter more and agree since at positions shifted by one. Each pair is found in one group
only: where beginnings agree in the groups by beginning, else in those by end. A task passes
on counts and best partners, never pairs.

Forms lead to a word at least twice as frequent, so chains of forms end; roots are found by
doubling along them.

Defined cases: null and empty texts have no runs; a run in a row with null ``doc_id`` is
hashed with an empty id. Rows with the same ``doc_id`` count each. Very long runs are words
like others (parts shrink with the length). Ties between near words go to the smallest in
code-point order. No words give no rows. Columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registrum.llm.common import only, shared_folder, slices, written

LEAST_LENGTH, LEAST_COUNT, SLIP = 5, 3, 97
#: A run in lower-cased UTF-8: letters of ASCII, and U+00C0 to U+00FF, whose first byte is C3.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
#: Words of a part of a group (fewer if they have more than LETTERS letters); small groups are worked off so many words at a time.
GROUP, LETTERS, PACK = 2048, 256, 512
BEGINNING, END = 0, 1


def runs(doc_id: int | None, text: str) -> Counter:
    """Runs of a text with their counts, slips made; those too short for a word are left out."""
    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in Counter(RUN.findall(text.encode("utf-8", "surrogatepass").lower())).items():
        if len(run) < LEAST_LENGTH:
            continue
        h = zlib.crc32(run, before)
        if h % SLIP == 0:
            letters = run.decode()
            at = h % len(letters)
            run = (letters[:at] + letters[at + 1 :]).encode()
        if len(run) - run.count(b"\xc3") >= LEAST_LENGTH:
            out[run] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of all words."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows, "text"):
            total: Counter = Counter()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:
                    total.update(runs(doc_id, text))
            words = pa.array(total.keys(), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([words, pa.array(total.values(), pa.int64())], ["word", "n"])

    counted = only(docs, "doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def dealt(words: DataFrame) -> DataFrame:
    """Words in their groups (kind, m, mark), parts by pairs (low, high, part)."""
    length = F.char_length("word")

    def key(kind: int, m):
        half = F.floor(m / 2).cast("int")
        shared = F.left("word", half) if kind == BEGINNING else F.right("word", half)
        return F.struct(F.lit(kind).alias("kind"), m.alias("m"), F.xxhash64(shared).alias("mark"))

    own = [key(kind, length) for kind in (BEGINNING, END)]
    longer = [key(kind, length - 1) for kind in (BEGINNING, END)]
    keys = F.when(length > LEAST_LENGTH, F.array(*own, *longer)).otherwise(F.array(*own))
    rows = words.select("word", "n", F.explode(keys).alias("x")).select("word", "n", "x.*")
    # A group needs a word of its shorter length and another one.
    sizes = rows.groupBy("kind", "m", "mark").agg(F.count(F.lit(1)).alias("count"), F.count_if(F.char_length("word") == F.col("m")).alias("shorter"))
    sizes = sizes.where("count > 1 AND shorter > 0")
    sizes = sizes.select("kind", "m", "mark", F.ceil(F.col("count") * F.greatest(F.lit(1), F.col("m") / LETTERS) / GROUP).cast("int").alias("parts"))
    rows = rows.join(sizes, ["kind", "m", "mark"])
    part = F.pmod(F.xxhash64(F.lit(1), "word"), F.col("parts")).cast("int")
    rows = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("kind", "m", "mark", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "word", "n")


class Index:
    """Bitsets over rows (words as bytes of Latin-1, one a letter) by position and letter."""

    def __init__(self, letters: np.ndarray):
        self.rows: list[np.ndarray] = []
        self.place = np.zeros((letters.shape[1], 256), np.int32)  # row 0 is the empty set
        for p in range(letters.shape[1]):
            there = np.unique(letters[:, p])
            there = there[there > 0]
            self.place[p, there] = np.arange(1, len(there) + 1)
            sets = np.packbits(letters[:, p] == there[:, None], axis=1)
            self.rows.append(np.vstack([np.zeros((1, sets.shape[1]), np.uint8), sets]))

    def having(self, p: int, letters: np.ndarray) -> np.ndarray:
        """For each letter, the set of rows with it at position p."""
        return self.rows[p][self.place[p, letters]]


def near_sets(letters: np.ndarray, length: np.ndarray, m: int, kind: int, may: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asked, same, longer): for each row of length m, which rows of length m and of m + 1 are near, of those it ``may`` meet.

    ``letters`` has m + 1 columns; ``may`` has a bitset for each row of length m.
    """
    index = Index(letters)
    asked = np.flatnonzero(length == m)
    q = letters[asked]
    zero, replaced, shifted = may.copy(), np.zeros_like(may), np.zeros_like(may)
    agree = zero
    for i in range(m):
        if i == m // 2:
            agree = zero.copy()
        match = index.having(i, q[:, i])
        shifted = (shifted | zero) & index.having(i + 1, q[:, i])
        replaced = (replaced & match) | (zero & ~match)
        zero &= match
    spared = agree if kind == BEGINNING else ~agree
    same = replaced & spared & np.packbits(length == m)
    longer = (shifted | zero) & spared & np.packbits(length == m + 1)
    return asked, same, longer


def partners(words: list[bytes], n: np.ndarray, group: np.ndarray, part: np.ndarray, m: int, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, count, best): rows with near words in the pack, how many, and which is most frequent.

    Rows stand in order of falling n and rising word, so the best is the first. Rows meet in
    the same group; ``part`` is their part if only different parts are to meet, else -1.
    """
    letters = np.zeros((len(words), m + 1), np.uint8)
    length = np.array([len(w) for w in words])
    for i, w in enumerate(words):
        letters[i, : len(w)] = np.frombuffer(w, np.uint8)
    short = length == m
    may = np.packbits((group[short, None] == group) & ((part[short, None] != part) | (part[short, None] < 0)), axis=1)
    asked, same, longer = near_sets(letters, length, m, kind, may)
    found = np.unpackbits(same | longer, axis=1, count=len(words)).astype(bool)
    count, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    count[asked] = found.sum(1)
    has = asked[count[asked] > 0]
    best[has] = found.argmax(1)[count[asked] > 0]
    back = found[:, length == m + 1]  # the longer partners hear of it here
    long = np.flatnonzero(length == m + 1)
    if len(asked) and len(long):
        count[long] = back.sum(0)
        heard = count[long] > 0
        best[long[heard]] = asked[back.argmax(0)[heard]]
    row = np.flatnonzero(count)
    return row, count[row], best[row]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near) of words (word, n) with near ones: how many, and the most frequent with its count."""
    keys = ("kind", "m", "mark", "low", "high")
    rows = dealt(words).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last: tuple = ()

        def out() -> pa.RecordBatch:
            held.sort(key=lambda r: (-r[3], r[2]))
            number: dict = {}
            group = np.array([number.setdefault(r[0], len(number)) for r in held])
            part = np.array([-1 if r[0][3] == r[0][4] else r[1] for r in held])
            n = np.array([r[3] for r in held], np.int64)
            row, count, best = partners([r[2].encode("latin-1") for r in held], n, group, part, held[0][0][1], held[0][0][0])
            columns = [pa.array([held[i][2] for i in row], pa.string()), pa.array(count, pa.int64()), pa.array(n[best], pa.int64()), pa.array([held[i][2] for i in best], pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["word", "count", "near_n", "near"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, "part", "word", "n")]
            for row in zip(*columns, strict=True):
                key = row[:5]
                if key != last and held and (key[:2] != last[:2] or len(held) >= PACK):  # a pack holds whole groups of one kind and length
                    yield out()
                    held = []
                last = key
                held.append((key, *row[5:]))
        if held:
            yield out()

    found = rows.mapInArrow(run, "word string, count long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("count").alias("n_near"), best).select("word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.word").alias("near"))


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """(word, root) of the words (word, form) that have a form."""
    now, i = written(forms.select("word", F.col("form").alias("root")), f"{folder}/roots-0"), 0
    while True:
        onward = now.toDF("root", "next")
        now, i = written(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"{folder}/roots-{i + 1}"), i + 1
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the texts."""
    folder = shared_folder(docs.sparkSession)
    words = written(vocabulary(docs), f"{folder}/words")
    near = words.join(near_words(words), "word", "left")
    has = F.col("near_n") >= 2 * F.col("n")
    formed = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n"))
    formed = written(formed, f"{folder}/forms")
    found = roots(formed.where("form IS NOT NULL").select("word", "form"), folder)
    return formed.join(found, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
