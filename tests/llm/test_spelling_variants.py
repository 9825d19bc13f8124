"""Spelling variants against edit distance over all pairs."""

import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from registrum.llm import spelling_variants as sv
from registrum.llm.queries import QUERIES
from test_llm import empty

SCHEMA = "doc_id long, text string, word string, n int, root string, kind int"


def brute_counts(data):
    counts = Counter()
    for i, t in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(data):
    n = brute_counts(data)
    names = sorted(n)
    near = {w: [] for w in names}
    ends: dict = {}
    for w in names:  # near words share one half of the shorter one's length; all pairs of these are tried
        for m in (len(w), len(w) - 1):
            for key in ((m, 0, w[: m // 2]), (m, 1, w[-(m // 2) :])):
                ends.setdefault(key, set()).add(w)
    for group in ends.values():
        for a in group:
            near[a] += [b for b in group if one_edit(a, b) and b not in near[a]]
    form = {}
    for w in names:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 2 * n[w]:
                form[w] = best
    out = []
    for w in names:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def test_registered_query(spark, small):
    rows = QUERIES["op12_spelling_variants"](spark, small)
    assert rows.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = brute(data)
    assert sorted(map(tuple, rows.collect()), key=lambda r: r[0]) == want and any(r[1] for r in want)


@pytest.mark.parametrize("group", [4, 2048])
def test_dense_words_and_cases(spark, monkeypatch, group):
    """All words of a small alphabet: every edit is there, groups are crowded and in parts."""
    monkeypatch.setattr(sv, "GROUP", group)
    pick = np.random.default_rng(2)
    data = [(int(i), " ".join(pick.choice(["".join(p) for k in (4, 5, 6) for p in product("abé", repeat=k)], 900))) for i in range(8)]
    long = "x" * 30_000
    data += [(20, None), (21, ""), (22, f"{long} {long} {long} {long}y " + f"{long}y " * 7), (None, "colour COLOUR Colour color " * 4), (23, "colour " * 9), (23, "colour " * 9), (24, "Étées étées naïve×naive 1abcde2 " * 5)]
    docs = spark.createDataFrame([(i, t, "w", 1, "r", 2) for i, t in data], SCHEMA)
    got = sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in sv.variants(docs).collect())
    assert got == brute(data) and len({r[2] for r in got}) < len(got)
    assert sv.variants(empty(docs)).count() == 0


def test_chains_lead_to_the_last(spark):
    """Words of one letter more and twice the count each: the root is the end of the chain."""
    chain = ["abcde" + "fghijklmnopq"[:k] for k in range(12)]
    docs = spark.createDataFrame([(1, " ".join(f"{w} " * (3 << k) for k, w in enumerate(chain)))], "doc_id long, text string")
    want = brute([(1, docs.first().text)])
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in sv.variants(docs).collect()) == want
    assert max(Counter(r[2] for r in want).values()) >= 10


def test_bit_sets_are_edit_distance():
    pick = np.random.default_rng(4)
    words = sorted({"".join(pick.choice(list("abc"), k)) for k in (6, 7) for _ in range(150)})
    n = np.arange(len(words), 0, -1)
    for kind in (sv.BEGINNING, sv.END):
        row, count, best = sv.partners([w.encode() for w in words], n, np.zeros(len(words), int), np.full(len(words), -1), 6, kind)
        got = dict(zip(row.tolist(), zip(count.tolist(), best.tolist(), strict=True), strict=True))
        for i, a in enumerate(words):
            near = [j for j, b in enumerate(words) if one_edit(a, b) and min(len(a), len(b)) == 6 and (a[:3] == b[:3]) == (kind == sv.BEGINNING)]
            assert got.get(i) == ((len(near), near[0]) if near else None)
