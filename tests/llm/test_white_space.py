"""Pieces of texts with white space besides blanks and line ends, against the library."""

import itertools

import numpy as np
import public_tokenizers
from registrum.llm import byte_pieces
from tokenizers import Tokenizer

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def test_white_space_is_the_library():
    texts = ["one\xa0two three\xa0four five\n\n", "a\tb\tc\n\n\nd", "a\rb\n\nc", "a\x1cb c\n\nd", "\na\tb c", "a\u3000b\u2028c d\n\n\n"]
    texts += ["x".join(p) for n in range(1, 6) for p in itertools.product(["", " ", "\n", "\t", "\xa0"], repeat=n)]
    whole = Tokenizer.from_file(BYTE)
    got = byte_pieces.encoder(BYTE).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
