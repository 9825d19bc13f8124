"""The pipeline's language stage with a language of thousands of characters."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_clean_documents_stay_at_any_size(spark, small):
    pick = random.Random(2)
    common = ["".join(chr(0x4E00 + pick.randrange(3000)) for _ in range(5)) for _ in range(20)]

    def chinese():
        return "".join(pick.choice(common) if pick.random() < 0.04 else chr(0x4E00 + pick.randrange(3000)) for _ in range(1000))

    def english():
        return " ".join(pick.choice(["the", "house", "of", "river", "stands", "near", "old", "trees"]) for _ in range(200))

    rows = [(i, chinese(), "zh", "s", 0) for i in range(150)] + [(i, english(), "en", "s", 0) for i in range(200, 260)]
    junk = [(i, "".join(chr(0x0430 + pick.randrange(32)) for _ in range(300)), None, "s", 0) for i in range(300, 310)]
    for some in (rows, rows[:10] + rows[150:160]):
        left = {r.doc_id for r in corpus_pipeline.identify_language(spark, spark.createDataFrame(some + junk, SCHEMA), small).collect()}
        assert left == {r[0] for r in some} | (left & {r[0] for r in junk}) and not left & {r[0] for r in junk}
