"""Benchmark passages in documents, also re-parameterised ones, through template windows.

Words of a text lose their outer punctuation and are lower-cased. A number becomes the
placeholder ``<num>``, a unit of measure after a number ``<unit>``, and a capitalised
word that does not begin a sentence ``<name>``; what was replaced is kept as the slots
of its type. What is left is a template. Windows of ``WINDOW`` template words with at
least ``LITERALS`` words that are no placeholders are hashed. A capitalised word that
begins a sentence or line may be a name or not: its windows are hashed in both forms, on
both sides.

A document's windows first pass a Bloom filter made from the benchmark's and sized by it,
so nearly none of them is shuffled; those that pass are hash-joined with the
benchmark's windows. Each hit tells at which offset between item and document it lies.
Nearby offsets (names may have other numbers of words) are one place. For one item, document and
place, all hits are gathered and their slots compared, across its offsets too: each
value of the item must correspond to one value of its type in the document and the
other way round. A hit whose slots contradict the majority does not count. The document
holds the item if consistent windows of a place cover at least ``COVER`` of its template windows.
An item shorter than the window is one window of its own length, looked for at every
place of every document. An item none of whose windows has ``LITERALS`` words that are no
placeholders is looked for as written: its windows hold the slots' values instead.

Defined cases: null texts hold nothing, and items without words are in nothing. A text
shorter than the window can only hold items that are not longer. Repeated rows of one id are one document; rows with a null id are not
reported. Repeated items are each reported. An empty benchmark reports nothing. Columns
besides those named are not read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from registrum.llm.common import only, remembered, shared_folder, slices, texts_of, written

WINDOW, LITERALS, COVER = 8, 4, 0.3
#: The filter on benchmark windows has at most 2 to this many bits.
MOST_BITS = 27
NUM, UNIT, NAME = "<num>", "<unit>", "<name>"
#: Units of measure and money, fixed.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t oz lb lbs gram grams kilogram kilograms ton tons ounce ounces pound pounds ml cl l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "kmh mph hz khz mhz ghz w kw kwh v a ohm j kj cal kcal pa bar k c f b kb mb gb tb percent % degrees degree "
    "dollar dollars cent cents euro euros usd eur gbp $ € £".split()
)
EDGES = re.compile(r"^[^\w$€£%<]+|[^\w$€£%>]+$")
NUMBER = re.compile(r"^[$€£]?[+-]?\d[\d.,:/]*(?:st|nd|rd|th)?%?$")
NUMBER_UNIT = re.compile(r"^([+-]?\d[\d.,]*)([a-z%€£$]+)$")
MARKS = ".,;:!?"
STOPS = (".", "!", "?", ":", ";", "\"", "»", "”")
NAME_WORDS = re.compile(r"^[^\W\d_][\w'’.-]*$")
#: Odd factors of a window's places.
PLACES = np.random.default_rng(WINDOW).integers(0, 1 << 64, WINDOW, np.uint64) | np.uint64(1)
HIT_SCHEMA = "doc_id long, h long, at long, slots array<string>"


def template(text: str) -> tuple[list[str], list[str]]:
    """Template words of a text, and the slot value at each placeholder ('' elsewhere)."""
    return template_forms(text)[:2]


def template_forms(text: str) -> tuple[list[str], list[str], list[bool]]:
    """``template``, and which words begin a sentence and may be names."""
    words: list[str] = []
    slots: list[str] = []
    initial: dict[int, bool] = {}
    begins = True
    for line in text.split("\n"):
        begins = True
        for raw in line.split():
            core = EDGES.sub("", raw)
            ends = raw.endswith(STOPS)
            if not core:
                begins = begins or ends
                continue
            low = core.lower()
            if NUMBER.match(low):
                words.append(NUM)
                slots.append(low.strip(".,"))
            elif low in UNITS and words and words[-1] == NUM:
                words.append(UNIT)
                slots.append(low)
            elif m := NUMBER_UNIT.match(low):
                if m[2] in UNITS:
                    words += [NUM, UNIT]
                    slots += [m[1], m[2]]
                else:
                    words.append(low)
                    slots.append("")
            elif core[0].isupper() and not begins and not core.isupper() and NAME_WORDS.match(core):
                words.append(NAME)
                slots.append(low)
            else:
                initial[len(words)] = core[0].isupper() and begins and not core.isupper() and bool(NAME_WORDS.match(core))
                words.append(low)
                slots.append("")
            begins = ends
    return words, slots, [initial.get(i, False) for i in range(len(words))]


def window_hashes(codes: np.ndarray, literal: np.ndarray, initial: np.ndarray, size: int = WINDOW, exact: bool = False, doc: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, form) of each window of ``size`` template words, given by their codes, with enough literals; ``exact`` ones need none.

    Bits of the form tell which words that begin a sentence are taken for names. With ``doc``,
    the words are those of several texts, and windows stay inside each.
    """
    n = len(codes) - size + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = np.concatenate([[0], np.cumsum(literal)])
    count = count[size:] - count[:-size]
    h = np.full(n, size + exact * 2 * WINDOW, np.uint64)
    for i in range(size):
        h += codes[i : i + n] * PLACES[i]
    wanted = np.ones(n, bool) if exact else count >= LITERALS
    if doc is not None:
        wanted &= doc[size - 1 :] == doc[:n]
    at = np.flatnonzero(wanted)
    h, count, form = h[at], count[at], np.zeros(len(at), np.int64)
    if not exact and initial.any():
        change = np.uint64(Words.NAME_CODE) - codes
        for i in range(size):
            can = np.flatnonzero(initial[at + i] & (count > LITERALS))
            h = np.append(h, h[can] + change[at[can] + i] * PLACES[i])
            form = np.append(form, form[can] | 1 << i)
            at, count = np.append(at, at[can]), np.append(count, count[can] - 1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h.view(np.int64), at, form


def windows(words: list[str], slots: list[str], initial: list[bool], size: int = WINDOW, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if exact:
        words = [s or w for w, s in zip(words, slots, strict=True)]
    codes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    return window_hashes(codes, np.array([not s for s in slots], bool), np.array(initial, bool), size, exact)


def window_slots(words: list[str], slots: list[str], at: int, form: int, size: int, exact: bool) -> list[str]:
    """Slots of a window; one that is looked for as written has none."""
    if exact:
        return [""] * size
    return [words[at + i] if form >> i & 1 else slots[at + i] for i in range(size)]


class Words(dict):
    """Numbers of words as written, and for each number what it means for a template: remembered, as words recur."""

    NAME_CODE, NUM_CODE, UNIT_CODE = (xxhash.xxh64_intdigest(w) for w in (NAME, NUM, UNIT))
    #: Bytes that may be remembered, and what a word takes besides its characters.
    MEMORY, ENTRY = 96 << 20, 190
    ENDS, EMPTY, MAY_NAME, NUMBER, IS_UNIT, BOTH = 1, 2, 4, 8, 16, 32

    def __init__(self) -> None:
        super().__init__()
        self.bytes = 0
        self.code, self.plain, self.flags = array("Q"), array("Q"), bytearray()

    def __missing__(self, raw: str) -> int:
        """A new word: code in a template, code as written, and whether it ends a sentence, is empty, may be a name, a number, a unit after a number, or both in one."""
        flags = self.ENDS if raw.endswith(STOPS) else 0
        core = raw[:-1] if raw[-1] in MARKS else raw
        if core.isalpha():  # the usual word; its letters say it all
            low = core.lower()
            code = plain = xxhash.xxh64_intdigest(low)
            if low in UNITS:
                flags |= self.IS_UNIT
            if core[0].isupper() and not core.isupper():
                flags |= self.MAY_NAME
        else:
            core = EDGES.sub("", raw)
            low = core.lower()
            code = plain = xxhash.xxh64_intdigest(low)
            if not core:
                flags |= self.EMPTY
            elif NUMBER.match(low):
                flags |= self.NUMBER
                plain = xxhash.xxh64_intdigest(low.strip(".,"))
            else:
                if low in UNITS:
                    flags |= self.IS_UNIT
                if (m := NUMBER_UNIT.match(low)) and m[2] in UNITS:
                    flags |= self.BOTH
                if core[0].isupper() and not core.isupper() and NAME_WORDS.match(core):
                    flags |= self.MAY_NAME
        self.code.append(code)
        self.plain.append(plain)
        self.flags.append(flags)
        self.bytes += self.ENTRY + len(raw)
        number = self[raw] = len(self.flags) - 1
        return number

    def templates(self, texts: list[str]) -> Templates:
        """The template words of all texts, one after the other."""
        if self.bytes > self.MEMORY:
            self.clear()
            self.__init__()
        words: list[str] = []
        lines: list[int] = []
        counts: list[int] = []
        for text in texts:
            before = len(words)
            for line in text.split("\n"):
                lines.append(len(words))
                words += line.split()
            counts.append(len(words) - before)
        number = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        flags = np.frombuffer(bytes(self.flags), np.uint8)[number]
        doc = np.repeat(np.arange(len(texts)), counts)
        begins = np.ones(len(words) + 1, bool)
        begins[1:] = flags & self.ENDS > 0
        begins[lines] = True
        empty = flags & self.EMPTY > 0
        for i in np.flatnonzero(empty):  # a word of which nothing is left hands on that a sentence begins
            begins[i + 1] |= begins[i]
        there = np.flatnonzero(~empty)
        number, flags, doc, begins = number[there], flags[there], doc[there], begins[there]
        num = flags & self.NUMBER > 0
        unit = flags & self.IS_UNIT > 0
        unit[1:] &= num[:-1] & (doc[1:] == doc[:-1])
        unit[:1] = False
        may = (flags & self.MAY_NAME > 0) & ~unit
        name = may & ~begins
        code = np.frombuffer(self.code.tobytes(), np.uint64)[number]
        plain = np.frombuffer(self.plain.tobytes(), np.uint64)[number]
        for mask, placeholder in ((num, self.NUM_CODE), (unit, self.UNIT_CODE), (name, self.NAME_CODE)):
            code[mask] = placeholder
        return Templates(code, ~(num | unit | name), may & begins, plain, doc, set(doc[flags & self.BOTH > 0].tolist()))


class Templates(NamedTuple):
    """Of each word: code in the template, whether it is no placeholder, may be a name that begins a sentence, code as written, number of its text. ``split``: texts with a word that makes two."""

    code: np.ndarray
    literal: np.ndarray
    initial: np.ndarray
    plain: np.ndarray
    doc: np.ndarray
    split: set[int]


def filter_bits(windows: int) -> int:
    """Bits of the filter on so many benchmark windows: 16 each, within bounds; a fuller filter only passes more on."""
    return 1 << min(max((16 * windows).bit_length(), 20), MOST_BITS)


def places(h: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Three places in a filter of ``size`` bits for each hash."""
    u = h.view(np.uint64)
    for shift in (0, 21, 37):
        yield ((u >> np.uint64(shift)) & np.uint64(size - 1)).astype(np.int64)


def passing(h: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets pass."""
    ok = np.arange(len(h))
    for shift in range(3):
        at = next(islice(places(h[ok], 64 * len(marked)), shift, None))
        ok = ok[(marked[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1]
    return ok


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, h, at, slots, size, exact and n (windows of the item) of every window."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: list[tuple] = []
            for item, text in zip(batch.column("item_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                words, slots, initial = template_forms(text)
                size = min(WINDOW, len(words))
                if not size:
                    continue
                h, at, form = windows(words, slots, initial, size)
                exact = not len(h)
                if exact:
                    h, at, form = windows(words, slots, initial, size, exact)
                n = len(np.unique(at))
                out += [(item, int(x), int(p), window_slots(words, slots, p, f, size, exact), size, exact, n) for x, p, f in zip(h, at, form, strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)

    names = ("item_id", "h", "at", "slots", "size", "exact", "n")
    schema = pa.schema([("item_id", pa.int64()), ("h", pa.int64()), ("at", pa.int64()), ("slots", pa.list_(pa.string())), ("size", pa.int64()), ("exact", pa.bool_()), ("n", pa.int64())])
    return only(benchmark, "item_id", "text").mapInArrow(run, "item_id long, h long, at long, slots array<string>, size long, exact boolean, n long")


def window_filter(items: DataFrame) -> np.ndarray:
    """Bits of the filter, in words of 64; each task marks its own and they are joined by ``or`` per word."""
    size = filter_bits(items.count())

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            h = batch.column("h").to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.unique(np.concatenate(list(places(h, size)))) if len(h) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], ["word", "bit"])

    found = items.select("h").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    rows = found.toArrow()  # at most a row for each 64 bits
    out = np.zeros(size // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def document_hits(docs: DataFrame, marked: np.ndarray, kinds: list[tuple[int, bool]]) -> DataFrame:
    """Windows of documents that pass the filter: doc_id, h, at, slots."""
    shared = docs.sparkSession.sparkContext.broadcast(marked)  # at most 2 ** MOST_BITS bits

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked = remembered("template words", Words)
        for batch in slices(rows, "text", keep=True):
            texts, ids = texts_of(batch.column("text")), batch.column("doc_id").to_pylist()
            made = looked.templates(texts)
            hit = set(made.split)
            for size, exact in kinds:
                h, at, _ = window_hashes(made.plain if exact else made.code, made.literal, made.initial, size, exact, made.doc)
                hit.update(made.doc[at[passing(h, shared.value)]].tolist())
            out: list[tuple] = []
            for i in sorted(hit):  # slots are only needed where a window passes
                words, slots, initial = template_forms(texts[i])
                for size, exact in kinds:
                    h, at, form = windows(words, slots, initial, size, exact)
                    out += [(ids[i], int(h[k]), int(at[k]), window_slots(words, slots, at[k], form[k], size, exact)) for k in passing(h, shared.value)]
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "h", "at", "slots"])

    types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
    return only(docs, "doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(run, HIT_SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows (consistent ones), cover, n_changed (slots with another value) of every item in a document."""
    items = written(item_windows(benchmark), f"{shared_folder(docs.sparkSession)}/items")
    kinds = [(r["size"], r["exact"]) for r in items.select("size", "exact").distinct().collect()]  # at most 2 * WINDOW
    if not kinds:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_windows long, cover double, n_changed long")
    hits = document_hits(docs, window_filter(items), sorted(kinds))
    item = items.select("item_id", "h", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), "n")
    pairs = hits.join(item, "h").where(F.size("slots") == F.size("item_slots"))
    pairs = pairs.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("offset"), "item_at", "n", "slots", "item_slots").dropDuplicates(["doc_id", "item_id", "offset", "item_at", "slots", "item_slots"])
    pairs = written(pairs, f"{shared_folder(docs.sparkSession)}/pairs")  # read three times below
    # Names of other numbers of words move what follows them: offsets at most a window apart are one place, which is no longer than the item and a window.
    ordered = Window.partitionBy("doc_id", "item_id").orderBy("offset")  # a row per offset of one item in one document
    offsets = pairs.groupBy("doc_id", "item_id", "offset").agg(F.first("n").alias("n"))
    new = F.coalesce((F.col("offset") - F.lag("offset").over(ordered) > WINDOW).cast("int"), F.lit(0))
    offsets = offsets.withColumn("run", new).withColumn("run", F.sum("run").over(ordered))
    begin = F.min("offset").over(Window.partitionBy("doc_id", "item_id", "run"))
    near = F.struct("run", F.floor((F.col("offset") - begin) / (F.col("n") + WINDOW)).alias("part")).alias("near")
    pairs = pairs.join(offsets.select("doc_id", "item_id", "offset", near), ["doc_id", "item_id", "offset"])
    # A place of an item in a document has at most as many windows at each of its offsets as the item, so it is a small group.
    place = ["doc_id", "item_id", "near"]
    slot = pairs.select(*place, "item_at", F.posexplode(F.arrays_zip(F.col("item_slots").alias("was"), F.col("slots").alias("is"))).alias("i", "v"))
    slot = slot.where("v.was <> ''").select(*place, (F.col("item_at") + F.col("i")).alias("p"), F.col("v.was").alias("was"), F.col("v.is").alias("is")).distinct()
    maps = slot.groupBy(*place, "was", "is").agg(F.count(F.lit(1)).alias("votes"))
    best = maps.groupBy(*place, "was").agg(F.max_by("is", F.struct("votes", "is")).alias("is"))
    back = maps.groupBy(*place, "is").agg(F.max_by("was", F.struct("votes", "was")).alias("was"))
    agreed = best.join(back, [*place, "was", "is"]).groupBy(*place).agg(F.map_from_entries(F.collect_list(F.struct("was", "is"))).alias("agreed"))
    judged = pairs.join(agreed, place, "left")
    fits = F.forall(F.arrays_zip(F.col("item_slots").alias("was"), F.col("slots").alias("is")), lambda v: (v["was"] == "") | F.coalesce(F.element_at(F.col("agreed"), v["was"]) == v["is"], F.lit(False)))
    changed = F.size(F.filter(F.map_entries(F.coalesce("agreed", F.create_map().cast("map<string,string>"))), lambda e: e["key"] != e["value"])).cast("long")
    whole = judged.where(fits).groupBy(*place).agg(F.count_distinct("item_at").alias("n_windows"), F.first("n").alias("n"), F.max(changed).alias("n_changed"))
    whole = whole.withColumn("cover", F.col("n_windows") / F.col("n")).where(F.col("cover") >= COVER)
    top = F.max_by(F.struct("n_windows", "cover", "n_changed"), F.struct("n_windows", "near"))
    return whole.groupBy("doc_id", "item_id").agg(top.alias("x")).select("doc_id", "item_id", "x.*")
