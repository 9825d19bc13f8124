"""The registered queries by name: columns, forms and values against plain code."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from registrum.llm import decontaminate, language_id, quality_pu
from registrum.llm.common import read
from registrum.llm.queries import QUERIES
from test_llm import brute_links, brute_print
from tokenizers import Tokenizer

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def data(spark, small):
    return sorted((r.doc_id, r.text, r.lang) for r in read(spark, small, "documents").collect())


def result(spark, small, name, columns):
    df = QUERIES[name](spark, small)
    assert df.columns[: len(columns)] == columns
    return sorted(tuple(r) for r in df.select(*columns).collect())


def third(i, n):
    return zlib.crc32(str(i).encode()) % n


def plain_trigrams(text):
    padded = f"\0{text.lower()}\0"
    return [tuple(c if c.isalpha() else "" for c in padded[k - 1 : k + 2]) for k in range(1, len(padded) - 1) if padded[k].isalpha()]


def test_op2_with_sets_for_filters(spark, small, data):
    got = {r[0]: r for r in result(spark, small, "op2_language_id", ["doc_id", "held_out", "lang_pred", "score"])}
    counts = defaultdict(Counter)
    for i, text, lang in data:
        if lang is not None and third(i, 3) != 1:
            counts[lang].update(plain_trigrams(text or ""))
    share = {lang: {g: n / sum(c.values()) for g, n in c.items() if n / sum(c.values()) >= language_id.MIN_SHARE} for lang, c in counts.items()}
    top = defaultdict(float)
    for s in share.values():
        for g, x in s.items():
            top[g] = max(top[g], x)
    members = {lang: {g for g, x in s.items() if x >= language_id.MIN_RATIO * top[g]} for lang, s in share.items()}
    same = 0
    for i, text, _ in data:
        grams = plain_trigrams(text or "")
        assert got[i][1] == (third(i, 3) == 1)
        if not grams:
            assert got[i][2:] == ("und", 0.0)
            continue
        found = sorted(((sum(g in m for g in grams) / len(grams), lang) for lang, m in members.items()), reverse=True)
        same += got[i][2] == found[0][1]
        assert abs(got[i][3] - found[0][0] / (found[0][0] + found[1][0])) < 0.02
    assert same >= 0.99 * len(data)


def test_op3_is_the_library(spark, small, data):
    whole, start, want = Tokenizer.from_file(BYTE), 0, []
    for i, text, _ in data:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert result(spark, small, "op3_token_blocks", ["doc_id", "start", "n_tokens", "ids_crc32"]) == want


def test_op4_is_brute_force(spark, small, data):
    prints = [(i, brute_print(t)) for i, t, _ in data]
    first = brute_links(prints)
    want = [(i, f"{p & (1 << 64) - 1:016x}", first[i]) for i, p in prints]
    assert result(spark, small, "op4_simhash", ["doc_id", "fingerprint", "component_id"]) == want


def test_op6_is_the_library(spark, small, data):
    whole, want = Tokenizer.from_file(WORD), []
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for i, text, _ in data:
        ids = whole.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(whole.decode(ids, skip_special_tokens=False))))
    assert result(spark, small, "op6_streaming_bpe", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == want


def test_op7_counts_are_the_library(spark, small, data):
    whole = Tokenizer.from_file(BYTE)
    whole.encode_special_tokens = True
    want = Counter(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in data)
    rows = QUERIES["op7_token_files"](spark, small).collect()
    assert Counter(r.n_tokens for r in rows) == want and all(r.closed for r in rows)
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0


def test_op8_columns_and_held_out_labels(spark, small, data):
    large = small.replace("sf0.001", "sf0.01")
    rows = result(spark, large, "op8_quality_pu", ["doc_id", "held_out", "score", "predicted"])
    assert all(h == (third(i, 5) == 0) and 0 <= s <= 1 and p == (s >= 0.3) for i, h, s, p in rows)
    quality = {r.doc_id: r.quality for r in read(spark, large, "labels").collect()}
    held = [p == quality[i] for i, h, _, p in rows if h and i in quality]
    assert len(held) > 30 and sum(held) >= 0.95 * len(held)


def test_op8_risk_and_choice_of_decay():
    pick = np.random.default_rng(3)
    good, bad = pick.normal(1, 1, (300, 4)), pick.normal(-1, 1, (200, 4))
    unlabelled = np.vstack([good[150:], bad])
    model = quality_pu.fit(good[:150], unlabelled, 150 / 350, 1.0, 50)
    loss = lambda x, sign: np.mean([1 / (1 + np.exp(sign * (sum((v - m) / s * w for v, m, s, w in zip(row, model.mean, model.spread, model.weights, strict=True)) + model.bias))) for row in x])
    by_hand = model.prior * loss(good[:150], 1) + max(0.0, loss(unlabelled, -1) - model.prior * loss(good[:150], -1))
    assert quality_pu.risk(model, good[:150], unlabelled) == pytest.approx(by_hand, abs=0.01)
    trials = {}
    for d in quality_pu.DECAYS:
        trials[d] = 0.0
        for fold in (0, 1):
            fitted = quality_pu.fit(good[:150][1 - fold :: 2], unlabelled[1 - fold :: 2], 150 / 350, d, quality_pu.TRIAL_STEPS)
            trials[d] += quality_pu.risk(fitted, good[:150][fold::2], unlabelled[fold::2])
    assert trials[quality_pu.chosen_decay(good[:150], unlabelled, 150 / 350)] == min(trials.values())


def test_op10_by_plain_loops(spark, small, data):
    """Every window of every item against every window of every text, slots and all."""
    rows = {(r.doc_id, r.item_id): r for r in QUERIES["op10_decontaminate"](spark, small).collect()}
    size = decontaminate.WINDOW
    items = {r.item_id: decontaminate.template(r.text or "") for r in read(spark, small, "benchmark").collect()}
    at = defaultdict(list)
    for item, (words, slots) in items.items():
        for k in range(len(words) - size + 1):
            if sum(not s for s in slots[k : k + size]) >= decontaminate.LITERALS:
                at[tuple(words[k : k + size])].append((item, k))
    windows = Counter(item for v in at.values() for item, _ in v)
    for i, text, _ in data:
        words, slots = decontaminate.template(text or "")
        same = defaultdict(lambda: defaultdict(set))
        for k in range(len(words) - size + 1):
            for item, j in at.get(tuple(words[k : k + size]), ()):
                if slots[k : k + size] == items[item][1][j : j + size]:
                    same[item][k - j].add(j)
        for item, offsets in same.items():
            if max(map(len, offsets.values())) >= decontaminate.COVER * windows[item] * 1.2:  # literal copies, well above the bound
                assert (i, item) in rows and rows[i, item]["cover"] >= decontaminate.COVER
        for (doc, item), r in rows.items():
            if doc == i:
                assert any(tuple(words[k : k + size]) in at for k in range(len(words) - size + 1)) or len(items[item][0]) < size or r["cover"] > 0
    assert rows
