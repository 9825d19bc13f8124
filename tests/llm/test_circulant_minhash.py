"""Circulant MinHash near duplicates against a brute-force Jaccard of whole sets."""

import random
from itertools import combinations

import numpy as np
import pytest
from registrum.llm import circulant_minhash as cm
from registrum.llm.queries import QUERIES
from test_llm import empty, words

SCHEMA = "doc_id long, text string, n long, key string, component string, marks int"


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def brute(data):
    """(doc_id, size, component) of each row, by all pairs."""
    sets = []
    for _, t in data:
        w = words(low(t))
        sets.append({tuple(w)} if 0 < len(w) < 4 else {tuple(w[i : i + 4]) for i in range(len(w) - 3)})
    first = {i: i for i, _ in data}
    for (x, (a, _)), (y, (b, _)) in combinations(enumerate(data), 2):
        both = len(sets[x] & sets[y])
        if both and 100 * both >= 80 * len(sets[x] | sets[y]):
            least, most = sorted((first[a], first[b]))
            first = {i: least if f == most else f for i, f in first.items()}
    return sorted((i, len(s), first[i]) for (i, _), s in zip(data, sets, strict=True))


def edited(seed=1):
    """Groups of texts at all similarities around the threshold."""
    pick, data = random.Random(seed), []
    for base in range(10):
        text = [pick.choice("abcdefghij") * pick.randint(1, 9) + str(pick.randint(0, 99)) for _ in range(pick.choice([9, 60, 400]))]
        for copy in range(7):
            data.append((10 * base + copy, " ".join(w if pick.random() > 0.006 * copy else "x" for w in text)))
    return data


ODD = [(200, None), (201, ""), (202, "one two"), (203, "One  Two"), (204, "one two three"), (205, " \n"), (10, "one two"), (10, "another text of the same id, which has some words"), (206, "word " * 9000), (207, "word word word word"), (208, "Ä b c d e f"), (209, "ä b c d e f")]


def test_registered_query(spark, small):
    rows = QUERIES["op11_circulant_minhash"](spark, small)
    assert rows.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows.collect()) == brute(data)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows.collect())


@pytest.mark.parametrize("group", [3, 4096])
def test_edited_texts_and_cases(spark, monkeypatch, group):
    monkeypatch.setattr(cm, "GROUP", group)  # crowded buckets and components are split
    data = [*edited(), *ODD]
    docs = spark.createDataFrame([(i, t, 0, "k", "c", 1) for i, t in [*data, (None, "one two"), (None, None)]], SCHEMA)
    got = [tuple(r) for r in cm.near_duplicates(docs).collect()]
    assert sorted(r for r in got if r[0] is not None) == brute(data)
    assert sorted(r[1] for r in got if r[0] is None) == [0, 1] and {r[2] for r in got if r[0] is None} == {None}
    assert cm.near_duplicates(empty(docs)).count() == 0


def test_text_of_megabytes(spark):
    text = " ".join(f"w{i * i % 999983}" for i in range(400_000))
    docs = spark.createDataFrame([(1, text), (2, text.replace("w1 ", "v1 ")), (3, text[: len(text) // 2])], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in cm.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_coordinates_estimate_similarity():
    """Shifts of one permutation agree as often as sets overlap, and spread no wider than independent ones."""
    pick = np.random.default_rng(5)
    shares = []
    for _ in range(200):
        common, a, b = (np.unique(cm.scattered(pick.integers(0, 1 << 60, n).astype(np.uint64))) for n in (240, 30, 30))
        found = cm.signatures([np.union1d(common, a), np.union1d(common, b)])
        shares.append((found[0] == found[1]).mean())
    assert abs(np.mean(shares) - 0.8) < 0.01 and np.std(shares) < 1.3 * (0.8 * 0.2 / (cm.BANDS * cm.ROWS)) ** 0.5


def test_forest_is_brute_force():
    pick = np.random.default_rng(3)
    base = np.arange(100, dtype=np.uint64)
    sets = sorted((np.unique(np.where(pick.random(100) < 0.1, pick.integers(1000, 9000, 100).astype(np.uint64), base)) for _ in range(60)), key=len)
    marks = np.zeros((60, cm.BANDS * cm.ROWS), np.uint8)
    root = cm.united(cm.by_sets(sets, marks), np.array([len(s) for s in sets]))
    want = list(range(60))
    for i, j in combinations(range(60), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            least, most = sorted((want[i], want[j]))
            want = [least if w == most else w for w in want]
    assert root.tolist() == want and len(set(want)) > 1
