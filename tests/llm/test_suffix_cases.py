"""Runs of NUL bytes, and rows of one id in different chunks, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from registrum.llm import suffix_dedup
from test_llm import brute_repeats


def letters(pick, n):
    return "".join(pick.choice("abcdefghijklmnop") for _ in range(n))


@pytest.mark.parametrize("chunk", [1, 200, 1 << 21])
def test_nul_runs(spark, chunk):
    pick = random.Random(5)
    text = letters(pick, 20) + "\0" * 60 + letters(pick, 20)
    data = [(1, text), (2, letters(pick, 9) + text), (3, letters(pick, 25) + "\0" * 16 + letters(pick, 25)), (4, "\0" * 300), (5, "x" + "\0" * 55)]
    check(spark, data, chunk)


@pytest.mark.parametrize("chunk", [1, 1 << 21])
def test_rows_of_one_id(spark, chunk):
    pick = random.Random(6)
    data = []
    for _ in range(30):
        own = letters(pick, 120)
        data += [(1, own[:90]), (2, own), (2, own), (2, "q" + own), (3, own[20:] + "z"), (2, letters(pick, 5) + own)]
    check(spark, data, chunk)


def check(spark, data, chunk):
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = suffix_dedup.deduplicated(docs, chunk).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert Counter(map(tuple, got.collect())) == brute_repeats(data)


def test_identifiers_are_made_once_to_remove(monkeypatch):
    """What goes, from units and from strings to probe, is found with one pass over the chunk's identifiers; documents may come in any order."""
    made = []
    own = suffix_dedup.units
    monkeypatch.setattr(suffix_dedup, "units", lambda raw, valid: made.append(len(valid)) or own(raw, valid))
    shared = bytes(range(65, 125)) + b"0123456789"
    texts = [shared + b"x" * 30, b"none of it " * 3, b"begin " + shared + b" end", shared[:55]]
    row = {"docs": [9, 4, 3, 7], "lengths": [len(t) for t in texts], "raw": b"".join(texts), "resolved": [], "strings": []}
    row["probe"] = [suffix_dedup.packed(np.unique(suffix_dedup.send_units(row)[1]))]
    made.clear()
    chunk, gone = suffix_dedup.removed(row)
    assert made == [len(row["raw"])]
    held, want = {}, []
    for doc, text in zip(row["docs"], texts):
        for i in range(len(text) - 49):
            held.setdefault(text[i : i + 50], []).append(doc)
    for doc, text in zip(row["docs"], texts):
        own_bytes = np.zeros(len(text), bool)
        for i in range(len(text) - 49):
            if min(held[text[i : i + 50]]) < doc:
                own_bytes[i : i + 50] = True
        want.append(own_bytes)
    assert (gone == np.concatenate(want)).all() and gone.any()
