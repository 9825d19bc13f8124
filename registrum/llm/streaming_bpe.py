"""BPE as a streaming transducer with bounded lookahead, and an incremental decoder.

Lookahead. Two texts that agree up to some byte can differ in their tokens before it
only through a chain of merges with ever later ranks, each of which takes the first
differing token, or what an earlier merge of the chain made there, as its right part
and so moves the difference left by the length of its left part. ``lookahead`` follows
all chains through the merge list in one pass and returns the largest way, in bytes:
a token that ends so far before the last byte read can't change any more. The encoder
buffers little more than that, emits the tokens that are stable and goes on from the
last boundary (no merge crosses it, so both sides are independent). Words shorter than
the buffer, nearly all, are merged once and remembered up to a bound.

Text. White space separates pieces and is dropped; pieces are normalised and cut into
pre-tokens as the tokenizer's file says: NFC, each character lower-cased by itself,
then contractions, letter runs, single numbers, runs of other characters. Strings of
added tokens are tokens themselves. For pieces with characters beyond Latin the library's
own normaliser and pre-tokeniser make the pre-tokens; the merges are always done here.

Decoding. A state machine is fed with blocks of ids. Tokens are joined by a space, as the
library does for a file without a decoder (``pieces``; the state is whether a token went before), or turned back into text: byte letters to
bytes, word ends to spaces, bytes to characters by a UTF-8 machine that holds at most three bytes.

Memory. Texts are split a block at a time; besides text and ids, what is held does not grow with the text,
only with its longest piece without white space.

Defined cases: null and empty texts have no tokens and decode to an empty text. Invalid
UTF-8 in ``text`` mode gives U+FFFD. Unknown ids fail. Repeated rows stay rows. Columns
besides those named are not read.
"""

from __future__ import annotations

import codecs
import heapq
import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registrum.llm.common import remembered, slices, texts_of

#: Memory of the worker for words, in bytes; what a word takes besides its letters and ids; the longest that is remembered.
MEMORY, ENTRY, MAX_WORD = 160 << 20, 170, 64
#: Characters of a text that are split at once, and ids that are decoded at once.
BLOCK, IDS = 1 << 18, 1 << 16
WORD_END = "</w>"
#: Bits of an id; a pair's ids, and a merge's rank and product, are packed into one number.
BITS = 20
NO_PAIR = 1 << 60
#: Below it, all characters are in normal form and their properties the same in all versions of Unicode.
LATIN_END = "\u0250"
#: Fixed values, from the tokenizer's file: its pre-token pattern.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
SPACE = regex.compile(r"\p{White_Space}+")
#: White space for str.split() but not for the tokenizer.
SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 itself, the others from U+0100 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def lookahead(merges: list[tuple[int, int, int]], size: list[int]) -> int:
    """Bytes after which a token is stable. merges: (left, right, product) by rank; size: bytes of each token.

    ``way[t]`` is the furthest that a difference can have moved when its first token is
    ``t``, over the merges so far; a token without merges starts at 0.
    """
    made = {p for _, _, p in merges}
    way = [-1 if t in made else 0 for t in range(len(size))]
    for left, right, product in merges:
        if way[left] < 0 and left in made or way[right] < 0 and right in made:
            raise ValueError("a merge uses a token that no earlier merge makes")
        moved = way[right] + size[left]
        stays = way[left]
        way[left] = max(way[left], moved)
        way[product] = max(way[product], moved, stays)
    return max(way, default=0) + 1  # whether the word ends is seen one byte later


#: A state machine: takes the next ids and gives the text that is certain, then gives the rest.
Decoder = tuple[Callable[[np.ndarray], str], Callable[[], str]]


class Bpe:
    """Encoder and decoder of one tokenizer file with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*vocab.items(), *self.added.items()]}
        self.inner = [vocab[x] for x in letters]
        self.final = [vocab[x + WORD_END] for x in letters]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        size = [0] * (max(self.token) + 1)
        for t, i in vocab.items():
            size[i] = len(t.removesuffix(WORD_END))
        steps = []
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            left, right, product = vocab[a], vocab[b], vocab[a + b]
            self.pairs[left, right] = rank, product
            steps.append((left, right, product))
        self.codes = {a << BITS | b: rank << BITS | product for (a, b), (rank, product) in self.pairs.items()}
        self.size = size
        self.lookahead = lookahead(steps, size)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.tokens: pa.Array | None = None
        self.byte_of = {x: i for i, x in enumerate(letters)}
        # Remembered ids, as the bytes of 32-bit numbers: of pieces as written, of pre-tokens.
        self.known: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.old_known, self.old_words, self.bytes = dict(self.known), dict(self.words), 0
        #: Bytes that each token spells, the space of a word end included.
        self.spelt = {i: bytes(self.byte_of[c] for c in t.removesuffix(WORD_END)) + b" " * t.endswith(WORD_END) for t, i in vocab.items()}
        self.spelt |= {i: t.encode() for t, i in self.added.items()}

    # ---- encoding

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges by rank, leftmost first."""
        if len(ids) > 48:
            return self._merge_long(ids)
        get, none, ids = self.codes.get, NO_PAIR, list(ids)
        ranks = [get(a << BITS | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            ids[i] = product = best & (1 << BITS) - 1
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << BITS | product, none)
            if i < len(ranks):
                ranks[i] = get(product << BITS | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        pairs, n, ids = self.pairs, len(ids), list(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(*pairs[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in pairs]
        heap = [(rank, i, product) for rank, product, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i, product = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or pairs.get((ids[i], ids[j])) != (rank, product):
                continue
            ids[i], ids[j] = product, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (ids[a], ids[b]) in pairs:
                    r, p = pairs[ids[a], ids[b]]
                    heapq.heappush(heap, (r, a, p))
        return [t for t in ids if t >= 0]

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one pre-token that arrives in chunks; holds a buffer of a few lookaheads."""
        held, full = bytearray(), 4 * self.lookahead
        for chunk in chunks:
            for i in range(0, len(chunk), full):
                held += chunk[i : i + full]
                if len(held) <= 2 * self.lookahead:
                    continue
                done = 0
                for t in self.merge([self.inner[b] for b in held]):
                    if done + self.size[t] > len(held) - self.lookahead:
                        break
                    done += self.size[t]
                    yield t
                del held[:done]
        if held:
            yield from self.merge([*[self.inner[b] for b in held[:-1]], self.final[held[-1]]])

    def word(self, piece: str) -> bytes:
        """Ids of a piece without white space."""
        out: list[bytes] = []
        at = 0
        for m in self.special.finditer(piece) if self.special else ():
            out += [*self._plain(piece[at : m.start()]), _ids([self.added[m[0]]])]
            at = m.end()
        return b"".join([*out, *self._plain(piece[at:])])

    def _plain(self, piece: str) -> Iterator[bytes]:
        for raw in self._pre_tokens(piece):
            if (ids := self.words.get(raw)) is not None:
                yield ids
            elif len(raw) <= MAX_WORD:
                self.bytes += ENTRY + 3 * len(raw)
                if (ids := self.old_words.get(raw)) is None:
                    ids = _ids(self.merge([*[self.inner[b] for b in raw[:-1]], self.final[raw[-1]]]))
                self.words[raw] = ids
                yield ids
            else:
                yield _ids(list(self.stream(raw[i : i + 4096] for i in range(0, len(raw), 4096))))

    def _pre_tokens(self, piece: str) -> Iterator[bytes]:
        if piece and max(piece) < LATIN_END:  # is in NFC as it stands
            return (pre.encode() for pre in PRE_TOKEN.findall(piece.lower()))
        # Other scripts: which characters are letters, and their case, is up to the library's version of Unicode.
        plain = self.library.normalizer.normalize_str(piece)
        found = self.library.pre_tokenizer.pre_tokenize_str(plain)
        return (bytes(map(self.byte_of.__getitem__, pre)) for pre, _ in found)

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text, as the bytes of 32-bit numbers."""
        if len(text) <= BLOCK:
            return self._block(text)
        out, at = bytearray(), 0
        while at < len(text):
            end = m.start() if (m := SPACE.search(text, at + BLOCK)) else len(text)
            out += self._block(text[at:end])
            at = end
        return bytes(out)

    def _block(self, text: str) -> bytes:
        known = self.known
        if self.bytes > MEMORY // 2:  # what was not used since the last turn is forgotten
            self.old_known, self.old_words, self.bytes = known, self.words, 0
            known = self.known = {}
            self.words = {}
        pieces = SPACE.split(text) if SEPARATORS.search(text) else text.split()
        found = [*map(known.get, pieces)]
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    piece = pieces[i]
                    if (ids := self.old_known.get(piece)) is None:
                        ids = self.word(piece)
                    found[i] = ids
                    if len(piece) <= MAX_WORD:
                        known[piece] = ids
                        self.bytes += ENTRY + len(piece) + len(ids)
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    # ---- decoding

    def joined(self) -> Decoder:
        """What the library's decode gives for a file without a decoder: tokens with a space between."""
        if self.tokens is None:
            self.tokens = pa.array([self.token.get(i) for i in range(max(self.token) + 1)], pa.string())
        begun = False

        def feed(ids: np.ndarray) -> str:
            nonlocal begun
            if not len(ids):
                return ""
            tokens = self.tokens.take(pa.array(ids))
            if tokens.null_count:
                raise KeyError("unknown id")
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(tokens)], pa.int32()), tokens), " ")[0].as_py()
            text, begun = " " + text if begun else text, True
            return text

        return feed, lambda: ""

    def joined_rows(self, ids: np.ndarray, ends: list[int]) -> list[str]:
        """``joined`` for rows of a block or less each, all at once."""
        self.joined()
        tokens = self.tokens.take(pa.array(ids))
        if tokens.null_count:
            raise KeyError("unknown id")
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens), " ").to_pylist()

    def spelling(self) -> Decoder:
        """The text that ids spell: word ends become spaces, an unfinished character waits for its bytes."""
        state, spelt = codecs.getincrementaldecoder("utf-8")("replace"), self.spelt
        return lambda ids: state.decode(b"".join([spelt[i] for i in ids.tolist()])), lambda: state.decode(b"", final=True)

    def text(self, ids: Iterable[int] | np.ndarray, mode: str = "text") -> Iterator[str]:
        """Text block by block."""
        feed, finish = self.joined() if mode == "pieces" else self.spelling()
        ids = ids if isinstance(ids, np.ndarray) else np.array([*ids], np.int64)
        for at in range(0, len(ids), IDS):
            yield feed(ids[at : at + IDS])
        yield finish()


def _ids(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


def bpe(path: str) -> Bpe:
    """The worker's tokenizer."""
    return remembered(("bpe", path), lambda: Bpe(path))


def _encoded(model: Bpe, texts: pa.Array) -> pa.ListArray:
    raw = [model.encode_bytes(t) for t in texts_of(texts)]
    ends = np.cumsum([0, *map(len, raw)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), np.int32)))


def _decoded(model: Bpe, ids: pa.ListArray, mode: str) -> pa.Array:
    size = pc.fill_null(pc.list_value_length(ids), 0).to_pylist()
    ends, flat = np.cumsum([0, *size]).tolist(), ids.flatten().to_numpy(zero_copy_only=False)
    if mode == "pieces" and max(size, default=0) <= IDS:
        return pa.array(model.joined_rows(flat, ends), pa.string())
    return pa.array(["".join(model.text(flat[a:b], mode)) for a, b in zip(ends, ends[1:], strict=False)], pa.string())


def _types(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def encoded(docs: DataFrame, path: str, *keep: Column) -> DataFrame:
    """``keep`` and ``ids`` of every row's whole text."""
    frame = docs.select(*keep, F.col("text").alias("_text"))
    kept = frame.columns[:-1]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in slices(rows, "_text", keep=True):
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], _encoded(model, batch.column("_text"))], [*kept, "ids"])

    return frame.mapInArrow(run, ", ".join([*[_types(frame, kept)] * bool(kept), "ids array<int>"]))


def decoded(coded: DataFrame, path: str, mode: str = "pieces") -> DataFrame:
    """``coded`` with ``decoded``: the tokens of ``ids`` joined (``pieces``), or the text they spell (``text``)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in slices(rows, "ids", keep=True):
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(model, batch.column("ids"), mode)], [*batch.schema.names, "decoded"])

    return coded.mapInArrow(run, f"{_types(coded, coded.columns)}, decoded string")


def transcoded(docs: DataFrame, path: str, *keep: Column, mode: str = "pieces") -> DataFrame:
    """``decoded`` of ``encoded`` by one worker a task: a second one would hold a tokenizer and its words too, and take the ids through Spark."""
    frame = docs.select(*keep, F.col("text").alias("_text"))
    kept = frame.columns[:-1]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in slices(rows, "_text", keep=True):
            ids = _encoded(model, batch.column("_text"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], ids, _decoded(model, ids, mode)], [*kept, "ids", "decoded"])

    return frame.mapInArrow(run, ", ".join([*[_types(frame, kept)] * bool(kept), "ids array<int>", "decoded string"]))
