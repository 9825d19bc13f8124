"""Benchmark items that are short, that are mostly slots, or whose sentences begin with names."""

from registrum.llm import decontaminate


def found(spark, items, docs):
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, items).collect()}


def test_short_items_inside_documents(spark):
    long = "It was asked here, and many more words stand around it: "
    items = ["What is the capital of France?", "Who wrote Faust", "How many legs has a red spider", "12 plus 30 is 42 7 9 times 3 5 11 60"]
    docs = [long + items[0] + " Nobody knew.", long + items[1] + " or not", long + items[2].replace("red", "blue"), long + items[3], long + items[3].replace("12", "13").replace("9", "8"), "x 12 plus 30 is 42 " + long, None, ""]
    got = found(spark, items, docs)
    assert set(got) == {(0, 0), (1, 1), (3, 3)}
    assert all(r["cover"] == 1.0 and r.n_changed == 0 for r in got.values())
    assert found(spark, ["one two"], ["zero one two three", "one. three two"]).keys() == {(0, 0)}


def test_names_that_begin_sentences(spark):
    item = "Alice had 3 apples. Alice gave 2 to Tom. Alice ate 1 more."
    docs = ["Look here: the text\n" + item.replace("Alice", "Bob") + " It ends.", "yesterday Bob had 3 apples. Bob gave 2 to Tom. Bob ate 1 more", "Then " + item, "Bob sold 3 cars. Bob lent 2 to Tom. Bob saw 1 more."]
    got = found(spark, [item], docs)
    assert {d for d, _ in got} == {0, 1, 2} and got[0, 0].n_changed == 1 and got[2, 0].n_changed == 0
    quest = "What is the capital of France?"
    assert found(spark, [quest], ["3 4 " + quest + " end"]).keys() == {(0, 0)}


def test_names_of_other_lengths(spark):
    parts = [" ".join(f"{a}{b}" for b in "abcdefghijkl") for a in "vwxy"]
    item = " Paris ".join(parts)
    assert found(spark, [item], [item.replace("Paris", "New York"), parts[0] + " and nothing else"]).keys() == {(0, 0)}


def test_slots_agree_across_offsets(spark):
    """One name of the item is two names in the document, once shifted by a word: the fewer windows do not count."""
    tail = " ".join(f"{a}{b}" for a in "vw" for b in "abcdefgh")
    item = "yesterday Paris had many old open small rooms and quiet long dark halls while then Paris sold few cold wet grey flat stones by " + tail
    same = item.replace("Paris", "Berlin")
    torn = item.replace("yesterday Paris", "yesterday Berlin").replace("then Paris", "then so Rome")
    got = found(spark, [item], [same, torn])
    assert got[0, 0]["cover"] == 1.0 and got[0, 0].n_changed == 1
    assert (1, 0) in got and got[1, 0].n_windows < got[0, 0].n_windows - 7


def test_pipeline_leaves_texts_with_a_word_of_an_item(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "the"), (2, "Which two oceans meet at the southern cape?")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = ["the cat sat on the mat", "He asked: Which two oceans meet at the southern cape? Nobody knew.", "the"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.drop_benchmark(spark, docs, str(tmp_path)).collect()} == {0, 2}
