"""Texts of several megabytes: what is worked off in blocks is what the library, or a plain loop, gives for the whole."""

import numpy as np
import public_tokenizers
import pytest
from registrum.llm import byte_pieces, streaming_bpe
from tokenizers import Tokenizer

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PICK = np.random.default_rng(5)
WORDS = ["".join(chr(97 + c) for c in PICK.integers(0, 26, PICK.integers(1, 12))) for _ in range(3000)] + ["Été", "naïve", "日本語", "it's", "<|endoftext|>", "x" * 300]


def text(n, seps=(" ", " ", " ", "\n", "  ", "\t", " \n")):
    parts = []
    for w, s in zip(PICK.choice(len(WORDS), n), PICK.choice(len(seps), n), strict=True):
        parts += [WORDS[w], seps[s]]
    return "".join(parts)


@pytest.mark.parametrize("seps", [(" ",), (" ", "\n", "  ", "\t"), (" ", "\x1c", "　")])
def test_word_bpe_in_blocks(seps):
    long = text(250_000, seps)
    assert len(long) > 4 * streaming_bpe.BLOCK
    whole = Tokenizer.from_file(WORD)
    want = whole.encode(long, add_special_tokens=False).ids
    model = streaming_bpe.bpe(WORD)
    got = model.encode(long)
    assert got == want and len(got) > 4 * streaming_bpe.IDS
    assert "".join(model.text(got, "pieces")) == whole.decode(want, skip_special_tokens=False)


def test_rows_of_all_lengths(spark):
    texts = [text(120_000), "", None, "one two", text(3)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = Tokenizer.from_file(WORD)
    coded = streaming_bpe.encoded(rows, WORD, rows.doc_id)
    for r in streaming_bpe.decoded(coded, WORD).collect():
        want = whole.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == whole.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("seps", [(" ", "\n"), (" ", "\n", "  ", "\t", "\n\n", "\x01")])
def test_byte_bpe_in_stretches(seps, monkeypatch):
    monkeypatch.setattr(byte_pieces, "MEMORY", 1 << 20)  # several turns of the memory
    long = text(150_000, seps).strip()
    short = [text(40, seps).strip() for _ in range(2000)]
    texts = [long, *short, long[: len(long) // 2]]
    coder = byte_pieces.PieceEncoder(BYTE, False, "<u4")
    whole = Tokenizer.from_file(BYTE)
    for _ in range(2):
        got = [coder.encode(texts[i : i + 400]) for i in range(0, len(texts), 400)]
        got = [ids for part in got for ids in part]
        for t, ids in zip(texts, got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
    assert byte_pieces.stretches(long) and "".join(byte_pieces.stretches(long)) == long


def test_words_are_remembered_in_arrays(monkeypatch):
    """60,000 words fit into 4 MB, with marks or without, and are not encoded again."""
    monkeypatch.setattr(byte_pieces, "MEMORY", 4 << 20)
    words = [f"w{i:x}" for i in range(60_000)]
    texts = [" ".join(["first", *words[i : i + 6_000]]) for i in range(0, len(words), 6_000)]
    coder, whole, seen = byte_pieces.PieceEncoder(BYTE, False, "<u4"), Tokenizer.from_file(BYTE), []
    encode = coder._ids
    monkeypatch.setattr(coder, "_ids", lambda t: seen.extend(t) or encode(t))
    for t in texts:
        coder.encode([t])
    n, marked = len(seen), [t.replace(" ", "., ") for t in texts]
    for t in marked:
        (ids,) = coder.encode([t])
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
    assert n and set(seen[n:]) == {".,"}
