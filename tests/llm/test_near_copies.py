"""The pipeline's near-dedup stage against a brute-force Jaccard of whole texts."""

import random
from itertools import combinations

import corpus_pipeline
import numpy as np
from registrum.llm import near_copies, simhash
from registrum.llm.common import read
from test_llm import empty, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_sets(text):
    w = words((text or "").lower())
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(data):
    sets, first = [brute_sets(t) for _, t in data], {i: i for i, _ in data}
    for (x, (a, _)), (y, (b, _)) in combinations(enumerate(data), 2):
        both = len(sets[x] & sets[y])
        if both >= 0.8 * (len(sets[x]) + len(sets[y]) - both):
            low, high = sorted((first[a], first[b]))
            first = {i: low if f == high else f for i, f in first.items()}
    return first


def test_given_documents(spark, small):
    docs = read(spark, small, "documents")
    first = brute_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == first and first[177] == 1  # 177 differs from 1 in 11 bits of its fingerprint
    left = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, small).collect()]
    assert sorted(left) == sorted({f for i, f in first.items()})


def test_edited_texts_and_cases(spark):
    pick = random.Random(1)
    data = []
    for base in range(12):
        text = [pick.choice("abcdefghij") * pick.randint(1, 9) + str(pick.randint(0, 99)) for _ in range(pick.choice([9, 60, 400]))]
        for copy in range(6):
            data.append((10 * base + copy, " ".join(w if pick.random() > 0.004 * copy * copy else "x" for w in text)))
    data += [(200, None), (201, ""), (202, "one two"), (203, "One  Two"), (204, "one two three"), (10, "one two"), (10, "another text of the same id, which has some words")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in [*data, (None, "one two")]], SCHEMA)
    got = {}
    for r in near_copies.near_copies(docs).collect():
        assert got.setdefault(r.doc_id, r.component_id) == r.component_id
    assert got.pop(None) is None and got == brute_components(data)
    assert got[201] == 200 and got[203] == got[202] == got[10]
    assert near_copies.near_copies(empty(docs)).count() == 0


def test_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "GROUP", 3)
    text = [f"w{i}" for i in range(300)]
    data = [(i, " ".join(w if k % 97 != i else "x" for k, w in enumerate(text))) for i in range(15)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert {r.component_id for r in near_copies.near_copies(docs).collect()} == {0}


def test_distances_beyond_64_bits():
    """Bit-sliced links over two words are those of counted bits, at any radius."""
    pick = np.random.default_rng(3)
    base = pick.integers(-(1 << 62), 1 << 62, (6, 2))
    prints = base[pick.integers(0, 6, 300)]
    for _ in range(14):
        prints[np.arange(300), pick.integers(0, 2, 300)] ^= np.left_shift(np.int64(1), pick.integers(0, 63, 300))
    group, node = np.sort(pick.integers(0, 3, 300)), pick.permutation(300)
    apart = np.unpackbits((prints[:, None] ^ prints).view(np.uint8), axis=2).sum(2, dtype=int)
    for radius in (3, 20, 26, 34):
        a, b = simhash.forest(prints.view(np.uint64), node, group, radius)
        pairs = [(node[i], node[j]) for i, j in combinations(range(300), 2) if group[i] == group[j] and apart[i, j] <= radius]
        brute, got = list(range(300)), list(range(300))
        for first, found in ((brute, pairs), (got, zip(a, b, strict=True))):
            for i, j in found:
                low, high = sorted((first[i], first[j]))
                first[:] = [low if f == high else f for f in first]
        assert got == brute and len(a) == 300 - len(set(brute))


def test_tables_meet_pairs_at_the_threshold():
    pick = np.random.default_rng(9)
    for nodes in (200, 50_000, 10**7):
        masks = np.array(near_copies.tables(nodes), np.int64)
        met = 0
        for _ in range(300):
            common, a, b = (np.unique(pick.integers(0, 1 << 62, n).astype(np.uint64)) for n in (240, 30, 30))
            x, y = near_copies.fingerprint(np.union1d(common, a)), near_copies.fingerprint(np.union1d(common, b))
            near = np.unpackbits((x ^ y).view(np.uint8)).sum() <= near_copies.RADIUS
            met += bool(near and (((x ^ y) & masks) == 0).all(1).any())
        assert met >= 0.97 * 300
