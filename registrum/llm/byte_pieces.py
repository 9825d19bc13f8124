"""Byte-level BPE of whole texts through the tokenizers library, one piece of text at a time.

The pattern of this tokenizer always starts a new pre-token at a single space, or line
end, that stands between two characters that are no white space, and what lies on both
sides is then encoded independently. Texts whose only white space is of that kind are cut there,
all texts of a call at once, and dictionary-encoded. Distinct pieces lose their marks, each distinct word is looked up once,
and what is not known goes through the library in strings of many: words meet at such cuts
again, and since the ids spell exactly the bytes of the text, the bytes of each id tell
which ids belong to which word. Ids of the texts are then taken by the pieces' numbers.
Pieces, words and ids are Arrow arrays throughout; Python sees whole texts, the joined strings and the library's ids.
Other texts go through the library in stretches that end at such cuts.
Words are remembered up to a bound in bytes, the least used forgotten first; long ones never are.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from registrum.llm.common import remembered

#: Memory of the worker for words and their ids, in bytes; the longest that is remembered, in characters.
MEMORY, MAX_LENGTH = 24 << 20, 40
#: Words and their ids, of no words.
NOTHING = pa.array([], pa.string()), pa.array([], pa.binary())
#: New words that go through the library in one string, strings in one call, and characters of a stretch of other texts.
JOINED, CALL, STRETCH = 64, 64, 1 << 15
#: Marks that can end a piece after a word; none is part of a contraction or of a special token's string.
MARKS = ".,;:!?)%&*$#"
#: Below it, what is a letter or digit is so in all versions of Unicode.
LATIN_END = "\u0250"
#: Stands before the first piece of a text; texts that hold it are cut otherwise.
FIRST = "\x01"
_CUT = re.compile(r"(?<!\s) (?!\s)")


class PieceEncoder:
    """``encode(texts)`` gives each text's ids as the bytes of unsigned numbers of ``dtype``."""

    def __init__(self, path: str, specials_are_text: bool, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = specials_are_text
        self.dtype = np.dtype(dtype)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) - 1 > np.iinfo(self.dtype).max:
            raise ValueError("ids do not fit")
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        added = self.tokenizer.get_added_tokens_decoder()
        #: Bytes that each id spells: a byte letter is a byte, an added token is its own text.
        self.spelt = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.spelt[i] = len(token.encode()) if i in added else len(token)
        #: Words and their ids, used since the last turn, and before it. A word follows a space unless it begins with a line end or ``FIRST``.
        self.known: tuple[pa.Array, pa.Array] = NOTHING
        self.old: tuple[pa.Array, pa.Array] = NOTHING

    @staticmethod
    def quick(text: str) -> bool:
        """Whether all white space of a text is single blanks and line ends between other characters."""
        words = text.split()
        return bool(words) and " ".join(words) == text.replace("\n", " ") and FIRST not in text

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text."""
        if sum(x.nbytes for x in self.known) > MEMORY // 2:
            self.old, self.known = self.known, NOTHING
        out: list[bytes] = [b""] * len(texts)
        quick = [i for i, t in enumerate(texts) if self.quick(t)]
        for i, ids in zip(quick, self._by_pieces([texts[i] for i in quick]), strict=True):
            out[i] = ids
        for i in set(range(len(texts))).difference(quick):
            out[i] = b"".join(ids.tobytes() for ids in self._ids(stretches(texts[i]))) if texts[i] else b""
        return out

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        lists = pc.split_pattern(pa.array([FIRST + t.replace("\n", " \n") for t in texts], pa.string()), " ")
        coded = lists.flatten().dictionary_encode()
        each = self._of_pieces(coded.dictionary).take(coded.indices)
        ends = np.frombuffer(each.buffers()[1], np.int32)[: len(each) + 1][lists.offsets.to_numpy()].tolist()
        raw = memoryview(each.buffers()[2])
        return [bytes(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

    def _of_pieces(self, pieces: pa.StringArray) -> pa.BinaryArray:
        """Ids of distinct pieces. A letter or digit and a mark after it are never in one pre-token: many pieces are a word and marks, encoded apart."""
        core = pc.ascii_rtrim(pieces, characters=MARKS)
        last = pc.utf8_slice_codeunits(core, -1).dictionary_encode()
        apart = np.array([c.isalnum() and c < LATIN_END for c in last.dictionary.to_pylist()], bool)[last.indices.to_numpy()]
        size = pc.binary_length(core).to_numpy()
        apart &= size < pc.binary_length(pieces).to_numpy()
        if not apart.any():
            return self._of_words(pieces)
        ended = np.flatnonzero(apart)
        words = pc.if_else(pa.array(apart), core, pieces).dictionary_encode()
        tails = pa.array([p[n:] for p, n in zip(pieces.take(ended).cast(pa.binary()).to_pylist(), size[ended].tolist(), strict=True)], pa.binary()).dictionary_encode()
        spelt = pa.array([ids.tobytes() for ids in self._ids([t.decode() for t in tails.dictionary.to_pylist()])], pa.binary())
        number = np.full(len(pieces), len(spelt))
        number[ended] = tails.indices.to_numpy()
        marks = pa.concat_arrays([spelt, pa.array([b""], pa.binary())]).take(pa.array(number))
        return pc.binary_join_element_wise(self._of_words(words.dictionary).take(words.indices), marks, b"")

    def _of_words(self, words: pa.StringArray) -> pa.BinaryArray:
        """Ids of distinct words: those remembered, and the library's of all others."""
        at = pc.index_in(words, value_set=pa.concat_arrays([self.known[0], self.old[0]]))
        missing = at.is_null()
        new = words.filter(missing)
        ids = pa.concat_arrays([self.known[1], self.old[1], self._learnt(new)])
        place = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        place[missing.to_numpy(zero_copy_only=False)] = len(ids) - len(new) + np.arange(len(new))
        out = ids.take(pa.array(place))
        kept = pa.array((place >= len(self.known[0])) & (pc.utf8_length(words).to_numpy() <= MAX_LENGTH))
        more = words.filter(kept), out.filter(kept)
        self.known = tuple(pa.concat_arrays(x) for x in zip(self.known, more, strict=True))
        return out

    def _learnt(self, words: pa.StringArray) -> pa.BinaryArray:
        """The library's ids of words that are not remembered."""
        # First pieces have nothing before them, so they can't stand among others.
        first = pc.starts_with(words, FIRST)
        if not pc.any(first).as_py():
            return self._joined(words)
        alone = pa.array([ids.tobytes() for ids in self._ids([w[1:] for w in words.filter(first).to_pylist()])], pa.binary())
        others = self._joined(words.filter(pc.invert(first)))
        place, is_first = np.empty(len(words), np.int64), first.to_numpy(zero_copy_only=False)
        place[is_first], place[~is_first] = np.arange(len(alone)), len(alone) + np.arange(len(others))
        return pa.concat_arrays([alone, others]).take(pa.array(place))

    def _joined(self, words: pa.StringArray) -> pa.BinaryArray:
        """Ids of each word, the blank or line end before it included."""
        if not len(words):
            return NOTHING[1]
        forms = pc.if_else(pc.starts_with(words, "\n"), words, pc.binary_join_element_wise(" ", words, ""))
        starts = pa.array(np.append(np.arange(0, len(forms), JOINED), len(forms)), pa.int32())
        strings = pc.binary_join(pa.ListArray.from_arrays(starts, forms), "").to_pylist()
        ids = np.concatenate(list(self._ids(strings)))
        ends, wanted = np.cumsum(self.spelt[ids]), np.cumsum(pc.binary_length(forms).to_numpy(), dtype=np.int64)
        cuts = np.searchsorted(ends, wanted)
        if ends[-1] != wanted[-1] or (ends[cuts] != wanted).any():
            raise ValueError("ids do not spell the bytes of the text")
        offsets = np.concatenate([[0], (cuts + 1) * self.dtype.itemsize]).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])

    def _ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        for i in range(0, len(texts), CALL):
            for e in self.tokenizer.encode_batch_fast(texts[i : i + CALL], add_special_tokens=False):
                yield np.array(e.ids, self.dtype)


def stretches(text: str) -> list[str]:
    """The text in parts of about ``STRETCH`` characters that are encoded independently."""
    out, at = [], 0
    while len(text) - at > STRETCH and (cut := _CUT.search(text, at + STRETCH)):
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def encoder(path: str, specials_are_text: bool = False, dtype: str = "<u4") -> PieceEncoder:
    """The worker's encoder, made once per worker and file."""
    key = path, specials_are_text, dtype
    return remembered(("pieces", *key), lambda: PieceEncoder(*key))


def narrowest(path: str, *more: int) -> str:
    """Two bytes an id if all ids of the file, and ``more``, fit into them; otherwise four."""
    largest = max(len(encoder(path).spelt) - 1, *more)
    return "<u2" if largest <= np.iinfo(np.uint16).max else "<u4"
