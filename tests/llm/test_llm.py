"""The training-data operators against brute force, and their defined cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from registrum.llm import (
    byte_pieces, components, decontaminate, language_id, line_dedup, quality_pu, quality_rules, simhash, streaming_bpe, suffix_dedup, token_blocks, token_files,
)
from registrum.llm.common import crc_bucket, read, shared_folder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"
LINE = "This line has well over forty characters in it, ÄÖ."
ODD = [
    (1, None), (2, ""), (3, "one"), (4, " \n \t\n"), (5, LINE + "\nfive"), (6, "six\n  " + LINE.upper().replace("Ä", "Ä") + " "), (7, LINE), (8, LINE), (9, LINE + "\n" + LINE),
    (10, "word " * 4000), (11, "a b c d e f a b c d e f"), (11, "a b c d e f a b c d e f"), (12, "x" * 9000), (13, "日本語 テキスト ΣΑΣ İ <|endoftext|> it's"), (14, "a  b\n\n c d\x1ce"),
    (15, "the same text of some length that two rows with different ids hold, word for word"), (16, "the same text of some length that two rows with different ids hold, word for word"), (None, LINE), (17, LINE + " \U0001f44d\U0001f3fd"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Edge cases, with extra columns whose names clash with those the operators make."""
    rows = [(i, t, "en", "s", 0, "x", 1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, score int")


@pytest.fixture(scope="module")
def docs(spark, small):
    return read(spark, small, "documents").select("doc_id", "text")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def empty(df):
    return df.where("false")


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


# ---- 1


def test_measures(docs, rows, odd):
    for frame, data in ((docs, rows), (odd, ODD)):
        want = Counter()
        for i, t in data:
            ws, t = words(t), t or ""
            runs = Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
            inside = {k + j for k in range(len(ws) - 4) if runs[tuple(ws[k : k + 5])] > 1 for j in range(5)}
            lines = [x for x in t.split("\n") if x.strip(BLANK)]
            want[i, len(ws), sum(map(len, ws)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(inside)] += 1
        got = quality_rules.ledger(frame).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert Counter(map(tuple, got.collect())) == want
    assert quality_rules.ledger(empty(odd)).count() == 0


def test_ablations_are_recounts(docs):
    book = quality_rules.ledger(docs).cache()
    bits = [r.fail_bits for r in book.collect()]
    for r in quality_rules.ablations(book).collect():
        mask = quality_rules.POLICIES[r.policy]
        bit = 1 << next(x.bit for x in quality_rules.RULES if x.name == r.rule)
        assert r.failed == sum(bool(b & mask & bit) for b in bits)
        assert r.alone == sum(b & mask == bit for b in bits)
        assert (r.kept, r.kept_without) == (sum(not b & mask for b in bits), sum(not b & mask & ~bit for b in bits))


# ---- 2


def test_language(spark, small, odd):
    table = read(spark, small, "documents")
    filters = language_id.learn(table.where(crc_bucket(F.col("doc_id"), 3) != 1))
    found = language_id.predict(table, filters, F.col("lang"), (crc_bucket(F.col("doc_id"), 3) == 1).alias("held_out")).where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    # No member is lost: each language's own n-grams have its bit.
    gram, _ = language_id.trigrams(["the thing"])
    seen = {r.doc_id: r for r in language_id.predict(odd, filters, F.col("doc_id")).collect()}
    assert seen[1].lang_pred == seen[2].lang_pred == seen[4].lang_pred == "und" and seen[1].score == 0
    assert all(0 <= r.score <= 1 for r in seen.values()) and len(gram)
    nothing = language_id.learn(empty(table))
    assert {r.lang_pred for r in language_id.predict(odd, nothing, F.col("doc_id")).collect()} == {"und"}
    assert language_id.predict(empty(odd), filters, F.col("doc_id")).count() == 0


def test_bit_sliced_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    members = {f"l{i}": rng.integers(0, 1 << 60, 500) for i in range(70)}  # more languages than bits of a word
    filters = language_id.Filters.build(members, dict.fromkeys(members, 1))
    for i, lang in enumerate(filters.languages):
        assert (filters.containing(members[lang])[i // 64] >> np.uint64(i % 64) & np.uint64(1)).all()


# ---- 3, 7


def test_packing_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 1001):
        v = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4") >> rng.integers(0, 32, n).astype("<u4")
        assert (token_blocks.unpack(*token_blocks.pack(v), n) == v).all()


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_token_blocks(spark, docs, odd, which):
    frame = {"docs": docs, "odd": odd}[which]
    library, folder = Tokenizer.from_file(BYTE), shared_folder(spark)
    token_blocks.write(frame, folder, BYTE, 2)
    got = token_blocks.read_back(spark, folder).orderBy("start").collect()
    data = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "", r.doc_id) for r in frame.collect()))
    start = 0
    assert len(got) == len(data)
    for r, (*_, text, i) in zip(got, data, strict=True):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_blocks_of_nothing(spark, odd):
    folder = shared_folder(spark)
    token_blocks.write(empty(odd), folder, BYTE, 2)
    assert token_blocks.read_back(spark, folder).count() == 0


def test_pieces_are_the_library(rows):
    texts = [*(t for _, t in rows[:60]), *(t or "" for _, t in ODD), " a   b", "x <|endoftext|> y", "trail ", "a　b 　 c"]
    for as_text in (False, True):
        library = Tokenizer.from_file(BYTE)
        library.encode_special_tokens = as_text
        got = byte_pieces.encoder(BYTE, as_text).encode(texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("block", [4, 64, token_files.BLOCK])
def test_token_files(spark, odd, block):
    folder, library = shared_folder(spark), Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True
    token_files.write(odd, folder, BYTE, 50256)
    got = token_files.lengths(token_files.blocks(spark, folder, 50256, block=block)).orderBy("doc_no").collect()
    assert Counter(r.n_tokens for r in got) == Counter(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ODD)
    assert [r.doc_no for r in got] == list(range(len(ODD))) and all(r.closed for r in got)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_documents_across_files(tmp_path, spark):
    """Documents that cross blocks and files, an empty file, and an end without end id."""
    ids = [5, 5, 9, 9, 5, 5, 5, 5, 9, 5]
    for k, part in enumerate((ids[:2], [], ids[2:6], ids[6:])):
        (tmp_path / f"f{k}").write_bytes(np.array(part, "<u2").tobytes())
    for block in (2, 4, 64):
        got = token_files.lengths(token_files.blocks(spark, f"file://{tmp_path}", 9, block=block)).orderBy("doc_no").collect()
        assert [(r.doc_no, r.start, r.n_tokens, r.closed) for r in got] == [(0, 0, 3, True), (1, 3, 1, True), (2, 4, 5, True), (3, 9, 1, False)]


# ---- 4


def brute_links(prints):
    """Smallest id reachable over pairs of at most three differing bits."""
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(prints):
        for j, b in prints[n + 1 :]:
            if (a ^ b).bit_count() <= 3 and (x := find(i)) != (y := find(j)):
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in prints}


def brute_print(text):
    ws = words((text or "").translate(LOW))
    h = [xxhash.xxh64_intdigest(" ".join(ws[k : k + 3]), 42) for k in range(max(1, len(ws) - 2))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    want = brute_links(prints)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (fp, want[i]) for i, fp in prints}


def test_simhash_cases(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.fp, r.component_id))
    assert by[1] == by[2] == by[4] == {(0, 1)} and by[16] == by[15] and {c for _, c in by[None]} == {None}
    assert simhash.near_duplicates(empty(odd)).count() == 0


def test_forest_is_exact():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    for n in (1, 2, 65, 400):
        group = np.sort(rng.integers(0, 3, n))
        fp = base[rng.integers(0, 4, n)] ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
        root = {k: k for k in range(n)}

        def find(k, root=root):
            while root[k] != k:
                k = root[k]
            return k

        for a, b in zip(*simhash.forest(fp, np.arange(n), group), strict=True):
            x, y = find(int(a)), find(int(b))
            root[max(x, y)] = min(x, y)
        want = {}
        for g in set(group.tolist()):
            want |= brute_links([(k, int(fp[k])) for k in np.flatnonzero(group == g).tolist()])
        assert {k: find(k) for k in range(n)} == want


def test_crowded_buckets_lose_no_link(spark):
    """More rows in a bucket than a group holds."""
    rng = np.random.default_rng(4)
    fp = np.unique(np.uint64(0x5DEECE66D << 20) ^ (np.uint64(1) << rng.integers(0, 30, 6000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 30, 6000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 30, 6000, dtype=np.uint64)))
    assert len(fp) > simhash.GROUP
    reps = spark.createDataFrame([(int(x), k) for k, x in enumerate(fp.view(np.int64).tolist())], "fp long, node long").select(F.col("fp").alias("node"), F.col("node").alias("fp")).select(F.col("fp").alias("node"), F.col("node").alias("fp"))
    folder = shared_folder(spark)
    got = components.components(simhash.links(reps.select("fp", "node"), folder), folder + "/c")
    assert got.select("component").distinct().count() == 1 and got.count() == len(fp) - 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (50, 50), (7, 7)] + [(200, 200 + k) for k in range(1, 30)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), shared_folder(spark)).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), 103: 100, 101: 100, **dict.fromkeys(range(201, 230), 200)}
    assert components.components(spark.createDataFrame([], "a long, b long"), shared_folder(spark)).count() == 0


# ---- 5


def brute_lines(data):
    holders = defaultdict(set)
    key = lambda x: x.strip(BLANK).translate(LOW)
    for i, t in data:
        if i is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= 40:
                    holders[key(x)].add(i)
    out = Counter()
    for i, t in data:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(holders[key(x)]) < 5 or max(holders[key(x)]) == i]
        out[i, len(lines), len(lines) - len(stay), "\n".join(stay)] += 1
    return out


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_line_dedup(docs, rows, odd, batches):
    for frame, data in ((docs, rows), (odd, ODD)):
        got = line_dedup.kept(frame, batches=batches).select("doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit("")))
        assert Counter(map(tuple, got.collect())) == brute_lines(data)
    assert set(odd.columns) < set(line_dedup.kept(odd).columns)


def test_line_dedup_of_nothing(odd):
    assert line_dedup.kept(empty(odd)).count() == 0


# ---- 6


def test_streaming_bpe(spark, docs, rows, odd):
    library = Tokenizer.from_file(WORD)
    for frame, data in ((docs, rows), (odd, ODD)):
        got = streaming_bpe.decoded(streaming_bpe.encoded(frame, WORD, F.col("doc_id")), WORD).collect()
        ids = [library.encode(t or "", add_special_tokens=False).ids for _, t in data]
        assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == Counter((i, tuple(x), library.decode(x, skip_special_tokens=False)) for (i, _), x in zip(data, ids, strict=True))
    assert streaming_bpe.encoded(empty(odd), WORD, F.col("doc_id")).count() == 0


def test_stable_prefix():
    """Tokens are emitted before a long word ends, and are those of the whole word."""
    model = streaming_bpe.bpe(WORD)
    rng = np.random.default_rng(5)
    for alphabet in (b"etaoinshrdlu", b"a", b"the ", bytes(range(33, 127))):
        raw = bytes(rng.choice(list(alphabet), 5000).tolist())
        whole = model.merge([*[model.inner[b] for b in raw[:-1]], model.final[raw[-1]]])
        assert list(model.stream(raw[i : i + 7] for i in range(0, len(raw), 7))) == whole
    fed = []
    tokens = model.stream(fed.append(i) or bytes(raw[i : i + 100]) for i in range(0, 5000, 100))
    next(tokens)
    assert len(fed) < 10


def test_decoder_is_incremental():
    model = streaming_bpe.bpe(WORD)
    assert "".join(model.text(model.encode("Hello wörld 日本語 <|endoftext|>!"))) == "hello wörld 日本語 <|endoftext|>! "
    with pytest.raises(ValueError):
        streaming_bpe.lookahead([(2, 0, 3), (0, 1, 2)], [1, 1, 2, 3])


# ---- 8


def test_quality(spark, small, odd):
    large = small.replace("sf0.001", "sf0.01")  # the smallest table has three held-out texts labelled bad
    table, marks = read(spark, large, "documents"), read(spark, large, "labels")
    held = crc_bucket(F.col("doc_id"), 5) == 0
    model = quality_pu.learn(table.where(~held), marks.where(~held).select("doc_id", F.col("quality").alias("label")))
    got = quality_pu.scored(table, model, F.col("doc_id"), held.alias("held")).join(marks, "doc_id").where("held").collect()
    assert sum((r.score >= 0.3) == (r.quality == 1) for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in quality_pu.scored(odd, model, F.col("doc_id")).collect())
    nothing = quality_pu.learn(table, empty(marks.select("doc_id", F.col("quality").alias("label"))))
    assert {r.score for r in quality_pu.scored(odd, nothing, F.col("doc_id")).collect()} == {0.5}
    assert quality_pu.scored(empty(odd), model, F.col("doc_id")).count() == 0


def test_pu_needs_no_negatives():
    rng = np.random.default_rng(6)
    good, bad = rng.normal(1.5, 1, (4000, 3)), rng.normal(-1.5, 1, (1000, 3))
    model = quality_pu.fit(good[:1500], np.vstack([good[1500:], bad]), 2500 / 3500)
    assert (model.score(good) > 0.5).mean() > 0.93 and (model.score(bad) < 0.5).mean() > 0.9


# ---- 9


def brute_repeats(data):
    out = Counter()
    at = defaultdict(lambda: 1 << 62)
    for i, t in data:
        raw = (t or "").encode()
        for k in range(len(raw) - 49 if i is not None else 0):
            at[raw[k : k + 50]] = min(at[raw[k : k + 50]], i)
    for i, t in data:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49 if i is not None else 0):
            if at[raw[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = sum(bool(g) and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i, len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()] += 1
    return out


@pytest.mark.parametrize("chunk", [3000, suffix_dedup.CHUNK])
def test_suffix_dedup(docs, rows, odd, chunk):
    for frame, data in ((docs, rows), (odd, ODD)):
        got = suffix_dedup.deduplicated(frame, chunk).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
        assert Counter(map(tuple, got.collect())) == brute_repeats(data)
    assert suffix_dedup.deduplicated(empty(odd)).count() == 0


# ---- 10

ITEM = "A train leaves Paris at 7 pm and travels 120 km in 3 hours while another train covers 120 km in 5 hours, which one arrives first?"


def test_decontamination(spark):
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "short item of five words"), (4, "")], "item_id long, text string")
    other = ITEM.replace("Paris", "Berlin").replace("120", "450").replace("km", "miles")
    torn = ITEM.replace("120 km in 5", "999 km in 5")  # one value of the item is two in the document
    data = [(1, f"Before it. {ITEM} After."), (2, f"Before it. {other} After."), (3, "nothing of the kind is in this text about other things, at all"), (4, None), (5, "Short item, of five words."), (6, "a short item of five words"), (7, torn), (1, f"Before it. {ITEM} After."), (None, ITEM)]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in data], "doc_id long, text string, h long, item_id string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, items).collect()}
    assert set(got) >= {(1, 1), (2, 1), (5, 3), (6, 3)} and {d for d, _ in got} <= {1, 2, 5, 6, 7}  # a short item is found inside longer texts too
    assert got[1, 1].n_changed == 0 and got[2, 1].n_changed == 3 and got[1, 1]["cover"] == 1.0
    assert (7, 1) not in got or got[7, 1]["cover"] < 1
    assert decontaminate.contaminated(empty(docs), items).count() == 0
    assert decontaminate.contaminated(docs, empty(items)).count() == 0


def test_decontamination_finds_planted(spark, small):
    docs, items = read(spark, small, "documents"), read(spark, small, "benchmark")
    squash = lambda t: " ".join(w.strip(".,").lower() for w in t.split())
    bench = {r.item_id: squash(r.text) for r in items.collect()}
    whole = {(r.doc_id, i) for r in docs.collect() for i, t in bench.items() if t in squash(r.text)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert whole and whole <= got


def test_batched_codes_are_the_template(rows):
    looked = decontaminate.Words()
    texts = [*(t for _, t in rows), *(t or "" for _, t in ODD), "Then Paris.\nThen -- Paris and (Rome) ran! Paris", "... A Bc. -- Dd Ee\n\n Ff Gg", "NATO and Nato met Mr. Smith", "5 km and 7 -- Kg, 3,\nmiles 12. 9 9 days", "He ran 5km in 2h with 7x", "km 5", "-- 5", "km"]
    made = looked.templates(texts)
    for i, text in enumerate(texts):
        if i in made.split:
            continue
        words_, slots, initial = decontaminate.template_forms(text)
        own = made.doc == i
        assert made.code[own].tolist() == [xxhash.xxh64_intdigest(w) for w in words_], text
        assert made.literal[own].tolist() == [not s for s in slots]
        assert made.initial[own].tolist() == initial
        assert made.plain[own].tolist() == [xxhash.xxh64_intdigest(s or w) for w, s in zip(words_, slots, strict=True)]
    assert 0 < len(made.split) < len(texts) / 10


def test_filter_grows_with_the_benchmark():
    assert decontaminate.filter_bits(1) == 1 << 20 and decontaminate.filter_bits(10**6) == 1 << 24 and decontaminate.filter_bits(10**12) == 1 << decontaminate.MOST_BITS
    h = np.random.default_rng(8).integers(-(1 << 62), 1 << 62, 1000)
    marked = np.zeros((1 << 20) // 64, np.uint64)
    for at in decontaminate.places(h[:500], 1 << 20):
        np.bitwise_or.at(marked, at >> 6, np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)))
    found = decontaminate.passing(h, marked).tolist()
    assert found[:500] == list(range(500)) and len(found) < 510
