"""The pipeline's stages against brute force, one after the other."""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from registrum.llm import streaming_bpe
from registrum.llm.common import COLUMNS_OF_DOCUMENTS as COLUMNS
from registrum.llm.common import read
from test_llm import brute_lines, empty
from test_near_copies import brute_components


def test_stages(spark, small):
    docs = read(spark, small, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "bpe"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, small)
        if name != "bpe":
            assert tuple(after.columns) == COLUMNS and after.dtypes == docs.select(*COLUMNS).dtypes
        after = after.cache()
        given, left = [(r.doc_id, r.text) for r in before.collect()], after.collect()
        if name == "language_id":
            assert {r.doc_id for r in left} <= {i for i, _ in given} and len(left) >= 0.99 * len(given)
        elif name == "line_dedup":
            assert {(r.doc_id, r.text) for r in left} == {(i, t) for i, _, _, t in brute_lines(given)}
            assert all(r.n_chars == len(r.text) for r in left)
        elif name == "simhash_near_dedup":
            first = brute_components(given)  # five-word shingles, similarity of 0.8 or more
            assert {r.doc_id for r in left} == {i for i, j in first.items() if i == j}
        elif name == "decontamination":
            assert 0 < len(given) - len(left) < 0.2 * len(given)
        else:
            assert {r.doc_id for r in left} == {i for i, _ in given} and all(r.n_tokens == len(r.ids) for r in left)
        before = after


def test_stages_of_odd_rows(spark, small):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "The thing and the other.", None, None, 1), (None, "The thing and the other.", "en", "a", 1), (3, "The thing and the other.", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert len(out.collect()) <= len(rows), name
        assert stage(spark, empty(docs), small).count() == 0


def test_last_stage_takes_one_worker_a_task(spark):
    """Ids and texts come from one pass, as from the two operators one after the other, whatever the texts are."""
    texts = ["", None, "Hello, World's   end.\n", "İstanbul ÄÖ 你好 x́ \x1c tab\t", "a" * 3000, "word " * 70000]
    docs = spark.createDataFrame([(i, t, "en", "web", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.tokenise(spark, docs.coalesce(1), "")
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    path = public_tokenizers.path(corpus_pipeline.TOKENIZER)
    coded = streaming_bpe.encoded(docs.coalesce(1), path, F.col("doc_id"), F.col("lang"), F.col("source"))
    for mode in ("text", "pieces"):
        want = streaming_bpe.decoded(coded, path, mode)
        found = streaming_bpe.transcoded(docs.coalesce(1), path, F.col("doc_id"), F.col("lang"), F.col("source"), mode=mode)
        assert found.schema == want.schema and found.collect() == want.collect()
    assert [r["n_tokens"] for r in got.collect()] == [len(r["ids"]) for r in coded.collect()]
