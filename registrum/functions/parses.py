"""Sizes, tag counts and structural means of parsed segments, an Arrow batch at a time.

Tokens of many segments lie in one flat array, so all of this is array arithmetic over
the numbers of segment, position and value; Python sees distinct values only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from registrum.schemas import STRUCTURAL_FEATURES

# Tokens that are worked on at a time; a longer segment is a part of its own.
PART_TOKENS = 1 << 16
# Bytes of text that are parsed and counted at a time; a longer document is a part of its own.
PART_BYTES = 1 << 19
MISSING_UPOS = "X"
# Elsewhere, lower case has the same length and does not depend on the characters around.
NOT_LATIN = "[^\x00-\u012f\u0131-\u024f]"
COUNTS = pa.list_(pa.struct([("value", pa.string()), ("n", pa.int32())]))
MEANS = pa.struct([(n, pa.float64()) for n in STRUCTURAL_FEATURES])


def counted_from(ends: np.ndarray) -> pa.Array:
    """Offsets of lists from their cumulated lengths."""
    return pa.array(np.concatenate([[0], ends]), pa.int32())


def owners(lists: pa.ListArray) -> np.ndarray:
    """The number of the list each element of the flattened array is in."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), lengths)


def places(owner: np.ndarray, n: int) -> np.ndarray:
    """0-based places within their lists, of the elements of ``n`` lists."""
    size = np.bincount(owner, minlength=n)
    return np.arange(len(owner)) - (np.cumsum(size) - size)[owner]


def lowered(texts: pa.Array) -> pa.Array:
    """Texts in lower case; Python sees those with characters beyond Latin only."""
    wide = pc.invert(pc.string_is_ascii(texts))
    beyond = texts.filter(wide)
    if not len(beyond):
        return pc.ascii_lower(texts)
    lower = pc.utf8_lower(texts)
    if _may_be_beyond_latin(beyond):
        other = pc.match_substring_regex(beyond, NOT_LATIN)
        by_python = pa.array([t.lower() for t in beyond.filter(other).to_pylist()], lower.type)
        lower = pc.replace_with_mask(lower, pc.replace_with_mask(wide, wide, other), by_python)
    return lower


def _may_be_beyond_latin(texts: pa.Array) -> bool:
    """Whether some byte begins a character beyond U+023F, or two spell U+0130, by one look at all bytes."""
    offset = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], offset)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return bool((data >= 0xC9).any() or ((data[:-1] == 0xC4) & (data[1:] == 0xB0)).any())


def _encoded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Values as numbers into an array of names, which holds the distinct ones; null counts as empty.

    What comes dictionary-encoded keeps its names; among them some may be the same.
    """
    if not pa.types.is_dictionary(values.type):
        values = values.dictionary_encode()
    codes, names = values.indices, pc.fill_null(values.dictionary, "")
    if codes.null_count:
        codes, names = pc.fill_null(codes, len(names)), pa.concat_arrays([names, pa.array([""], names.type)])
    return codes.to_numpy(zero_copy_only=False).astype(np.int64), names


def _taken(of_value: pa.Array | np.ndarray, codes: np.ndarray) -> np.ndarray:
    """What holds of distinct values, for each of their numbers."""
    return (of_value if isinstance(of_value, np.ndarray) else of_value.to_numpy(zero_copy_only=False))[codes]


def _ratio(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, total / np.maximum(n, 1), 0.0)


def _sums(owner: np.ndarray, n: int, values: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, values, minlength=n)


def _sums_to(ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of whole numbers, or of truth values, that lie list by list up to the lists' ends."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[ends], prepend=0)


def moving_ttr(owner: np.ndarray, codes: np.ndarray, n: int, window: int) -> np.ndarray:
    """Moving-average type-token ratio per owner, in whose order the tokens come; as :func:`registrum.functions.arrays.moving_ttr`."""
    size = _sums(owner, n)
    ends = np.cumsum(size)
    number = np.arange(len(owner))
    pos = number - np.repeat(ends - size, size)
    # One sort of numbers made of code and place: how far back the same code stands, whoever's it is.
    bits = max(len(owner), 1).bit_length()
    key = np.sort((codes.astype(np.int64) << bits) | number)
    order = key & ((1 << bits) - 1)
    gap = np.full(len(key), len(key) + 1, np.int64)
    gap[order[1:]] = np.where(key[1:] >> bits == key[:-1] >> bits, np.diff(order), len(key) + 1)
    previous = np.maximum(pos - gap, -1)
    low = np.maximum(previous + 1, pos - (window - 1))
    high = np.minimum(pos, np.repeat(size - window, size))
    total = _sums_to(ends, np.maximum(high - low + 1, 0))
    types = _sums_to(ends, previous < 0)
    moving = total / float(window) / np.maximum(size - (window - 1), 1)
    return np.where(size < window, _ratio(types, size), moving)


def _counted(key: np.ndarray, width: int, n: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys below ``n * width``, ascending, and how often each comes."""
    if n * width <= 4 * PART_TOKENS:
        dense = np.bincount(key, times, minlength=n * width).astype(np.int64)
        found = np.flatnonzero(dense)
        return found, dense[found]
    found, at, counts = np.unique(key, return_inverse=True, return_counts=True)
    return found, counts if times is None else np.bincount(at, times, minlength=len(found)).astype(np.int64)


def _tag_lists(owner: np.ndarray, rank: np.ndarray, times: np.ndarray, names: list[str], n: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Names of each owner with their numbers of occurrences: list ends, names and counts in name order."""
    width = max(len(names), 1)
    key, counts = _counted(owner * width + rank, width, n, times)
    ends = np.cumsum(_sums(key // width, n))
    return ends, pa.array(names, pa.string()).take(pa.array(key % width)), counts


def _whole(numbers: pa.Array) -> np.ndarray:
    """Whole numbers, null as 0."""
    return (pc.fill_null(numbers, 0) if numbers.null_count else numbers).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def records_of(sentences: pa.ListArray, window: int) -> dict[str, pa.Array]:
    """Per segment: content words, sentences with any, distinct tags, tag counts and structural means."""
    n = len(sentences)
    tokens = pc.struct_field(sentences.flatten(), "tokens")
    of_sentence = owners(sentences)
    each = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    sentence_ends = np.cumsum(each, dtype=np.int64)
    segment = np.repeat(of_sentence, each)
    ends = np.cumsum(_sums(segment, n))
    flat = dict(zip([f.name for f in tokens.type.value_type], tokens.flatten().flatten()))

    upos, upos_names = _encoded(flat["upos"])
    content = _taken(pc.not_equal(upos_names, "PUNCT"), upos)
    lengths = _sums_to(sentence_ends, content)
    n_tokens, n_sents = _sums_to(ends, content), _sums(of_sentence[lengths > 0], n)

    # Tags follow from the segments' distinct values, which are few, and their numbers.
    deprel, deprel_names = _encoded(flat["deprel"])
    feats, feats_names = _encoded(flat["feats"])
    items = {
        "upos": [[v] if v else [] for v in upos_names.to_pylist()],
        "deprel": [[v] if v else [] for v in deprel_names.to_pylist()],
        "feats": [[kv for kv in f.split("|") if "=" in kv] for f in feats_names.to_pylist()],
    }
    names = sorted({f"{kind}\t{v}" for kind, values in items.items() for x in values for v in x} | {f"upos\t{MISSING_UPOS}"})
    at = {name: i for i, name in enumerate(names)}
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for kind, codes in (("upos", upos), ("deprel", deprel), ("feats", feats)):
        width = max(len(items[kind]), 1)
        key, times = _counted(segment * width + codes, width, n)
        code = key % width
        size = np.array([len(x) for x in items[kind]], np.int64)
        ranks = np.array([at[f"{kind}\t{v}"] for x in items[kind] for v in x], np.int64)
        many = size[code]
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        found.append((np.repeat(key // width, many), ranks[np.repeat((np.cumsum(size) - size)[code], many) + within], np.repeat(times, many)))
    tag_ends, tags, _ = _tag_lists(*map(np.concatenate, zip(*found)), names, n)
    without = _sums_to(ends, _taken(pc.equal(upos_names, ""), upos))
    lacking = np.flatnonzero(without)
    found.append((lacking, np.full(len(lacking), at[f"upos\t{MISSING_UPOS}"], np.int64), without[lacking]))
    count_ends, values, counts = _tag_lists(*map(np.concatenate, zip(*found)), names, n)

    head, number = _whole(flat["head"]), _whole(flat["id"])
    linked = head > 0
    if flat["id"].null_count:
        linked &= flat["id"].is_valid().to_numpy(zero_copy_only=False)
    text, text_names = _encoded(flat["text"])
    length = _taken(pc.utf8_length(text_names), text)
    word = content & (length > 0)
    lemma, lemma_names = _encoded(flat["lemma"])
    no_lemma = pc.equal(lemma_names, "").to_numpy(zero_copy_only=False)
    # Words and lemmas are numbered together, so a lemma that is the word itself has its number.
    lower, _ = _encoded(lowered(pa.concat_arrays([text_names, lemma_names])))
    lower_text, lower_lemma = lower[: len(text_names)][text], lower[len(text_names) :][lemma]
    has_lemma = content
    if no_lemma.any():
        lower_lemma = np.where(no_lemma[lemma], lower_text, lower_lemma)
        has_lemma = np.where(no_lemma[lemma], word, content)
    words = moving_ttr(segment[word], lower_text[word], n, window)
    same = np.array_equal(word, has_lemma) and np.array_equal(lower_text[word], lower_lemma[word])
    n_linked, n_words = _sums_to(ends, linked), _sums_to(ends, word)
    means = [
        _ratio(n_tokens, n_sents),
        _ratio(_sums_to(ends, np.where(linked, np.abs(head - number), 0)), n_linked),
        _ratio(_sums_to(ends, np.where(word, length, 0)), n_words),
        words,
        words if same else moving_ttr(segment[has_lemma], lower_lemma[has_lemma], n, window),
    ]
    absent = pc.is_null(sentences).to_numpy(zero_copy_only=False)
    return {
        "n_tokens": pa.array(n_tokens, pa.int64(), mask=absent),
        "n_sents": pa.array(n_sents, pa.int64(), mask=absent),
        "tags": pa.ListArray.from_arrays(counted_from(tag_ends), tags),
        "counts": pa.ListArray.from_arrays(
            counted_from(count_ends), pa.StructArray.from_arrays([values, pa.array(counts, pa.int32())], fields=list(COUNTS.value_type))
        ),
        "means": pa.StructArray.from_arrays([pa.array(m, pa.float64()) for m in means], fields=list(MEANS)),
    }


def parts(batch: pa.RecordBatch, sentences: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``PART_TOKENS`` tokens, in order."""
    column = batch.column(sentences)
    tokens = pc.list_value_length(pc.struct_field(column.flatten(), "tokens"))
    each = _sums(owners(column), len(column), pc.fill_null(tokens, 0).to_numpy(zero_copy_only=False))
    starts = np.flatnonzero(np.diff(np.cumsum(each) // PART_TOKENS, prepend=-1)).tolist()
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def text_parts(batch: pa.RecordBatch, segments: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``PART_BYTES`` bytes of segments' texts, in order."""
    column = batch.column(segments)
    size = pc.fill_null(pc.binary_length(pc.struct_field(column.flatten(), "text")), 0).to_numpy(zero_copy_only=False)
    each = _sums(owners(column), len(column), size)
    starts = np.flatnonzero(np.diff(np.cumsum(each) // PART_BYTES, prepend=-1)).tolist()
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def block_of(records: pa.RecordBatch) -> tuple[pa.Array, bytes]:
    """The distinct tags of segments' records, and the records without them as one value; tags are numbers there."""
    tags = pc.unique(records.column("tags").flatten())
    at = records.schema.get_field_index("counts")
    counts = records.column(at)
    values, n = (pc.struct_field(counts.flatten(), f) for f in ("value", "n"))
    counts = pa.ListArray.from_arrays(counts.offsets, pa.StructArray.from_arrays([values.dictionary_encode(), n], ["value", "n"]))
    records = records.set_column(at, "counts", counts).drop_columns(["tags"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, records.schema) as out:
        out.write_batch(records)
    return tags, sink.getvalue().to_pybytes()


def records_in(block: pa.Buffer) -> pa.RecordBatch:
    with pa.ipc.open_stream(block) as stream:
        return stream.read_next_batch()


def kept_of(records: pa.RecordBatch, exclude_labels: list[str], min_tokens: int) -> pa.RecordBatch:
    """Records with content words, as many as asked for, under other labels."""
    n = pc.fill_null(records.column("n_tokens"), 0)
    other = pc.invert(pc.is_in(records.column("label"), pa.array(exclude_labels, pa.string())))
    return records.filter(pc.and_(pc.greater_equal(n, max(min_tokens, 1)), other))


def rates_of(records: pa.RecordBatch, columns: dict[str, str], per: float) -> dict[str, np.ndarray]:
    """For each column the rate of its tag, zero where it is absent."""
    counts = records.column("counts")
    found = counts.flatten()
    value, names = _encoded(pc.struct_field(found, "value"))
    owner, n = owners(counts), pc.struct_field(found, "n").to_numpy(zero_copy_only=False)
    place = {tag: i for i, tag in enumerate(columns.values())}
    at = np.array([place.get(tag, -1) for tag in names.to_pylist()], np.int64)[value]
    dense = np.zeros((len(place), len(records)))
    dense[at[at >= 0], owner[at >= 0]] = n[at >= 0]
    rates = per * dense / records.column("n_tokens").to_numpy(zero_copy_only=False)
    return dict(zip(columns, rates))


def means_of(records: pa.RecordBatch) -> dict[str, pa.Array]:
    means = records.column("means")
    return {n: pc.struct_field(means, n) for n in STRUCTURAL_FEATURES}
