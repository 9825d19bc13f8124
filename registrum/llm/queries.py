"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.llm import centroid_clustering, circulant_minhash, decontaminate, language_id, line_dedup, quality_pu, quality_rules, simhash, spelling_variants, streaming_bpe, suffix_dedup, token_blocks, token_files
from registrum.llm.common import crc_bucket, read, shared_folder

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: The end id of op3 is set by its contract; op7's is the id that no text can have.
BLOCK_END, FILE_END = 2, 50256


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.stored(read(spark, sf_dir, "documents"))
    book = quality_rules.apply_policy(book, quality_rules.POLICIES["base"], "_base")
    book = quality_rules.apply_policy(book, quality_rules.POLICIES[quality_rules.PRODUCTION])
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("_base")).alias("base_failed"), "kept", "fail_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule does in each policy, from the ledger alone."""
    return quality_rules.ablations(quality_rules.stored(read(spark, sf_dir, "documents")))


#: The ledger in SQL; the rules' own conditions are SQL over the measures.
_LEDGER = f"""words AS (
    SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
    FROM documents
), windows AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n
    FROM (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM words))
), covered AS (
    SELECT r, count(DISTINCT i + j) AS n FROM windows, (SELECT unnest(range(5)) AS j) WHERE windows.n > 1 GROUP BY r
), measured AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
           length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l)::BIGINT AS n_lines,
           (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
           len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1]))::BIGINT AS n_echo_words,
           length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS n_lower
    FROM words LEFT JOIN covered USING (r)
), ledger AS (
    SELECT *, ({" + ".join(f"(CASE WHEN {x.fails} THEN {1 << x.bit} ELSE 0 END)" for x in quality_rules.RULES)})::BIGINT AS fail_bits FROM measured
)"""
_ABLATION_CELLS = ", ".join(
    f"('{version}', '{x.name}', {mask}, {1 << x.bit})" for version, mask in quality_rules.POLICIES.items() for x in quality_rules.RULES if mask >> x.bit & 1
)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id"), 3) == 1
    filters = language_id.learn(docs.where(~held_out))
    return language_id.predict(docs, filters, F.col("doc_id"), held_out.alias("held_out"))


def op3_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    token_blocks.write(read(spark, sf_dir, "documents"), folder, public_tokenizers.path(BYTE_BPE), BLOCK_END)
    return token_blocks.read_back(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.kept(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(WORD_BPE)
    coded = streaming_bpe.encoded(read(spark, sf_dir, "documents"), path, F.col("doc_id"))
    both = streaming_bpe.decoded(coded, path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    token_files.write(read(spark, sf_dir, "documents"), folder, public_tokenizers.path(BYTE_BPE), FILE_END)
    return token_files.lengths(token_files.blocks(spark, folder, FILE_END))


def op8_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    labels = read(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    model = quality_pu.learn(docs.where(~held_out), labels)
    out = quality_pu.scored(docs, model, F.col("doc_id"), held_out.alias("held_out"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicated(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = circulant_minhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling_variants.variants(read(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = centroid_clustering.clusters(read(spark, sf_dir, "embeddings"))
    digests = F.array(*[F.lit(d) for d in centroid_clustering.digests(centroids)]).cast("array<string>")
    return found.withColumn("centroid_sha256", F.get(digests, F.col("cluster")))


def kmeans_sql(k: int, rounds: int, seed: int, d: int) -> str:
    """op13 in SQL: a table of assignments and one of centroids a round."""

    def nearest(c: str) -> str:
        # Not arg_min: ties must go to the smaller number.
        return f"""SELECT vec_id, rid, cluster, distance FROM (
            SELECT v.vec_id, v.rid, c.cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance,
                   row_number() OVER (PARTITION BY v.rid ORDER BY distance, c.cluster) AS r
            FROM v, {c} c) WHERE r = 1"""

    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE len(embedding) = {d} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {d})""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1)::INT AS cluster, x FROM v WHERE vec_id IS NOT NULL ORDER BY cluster LIMIT {k})",
    ]
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({nearest(f'c{i}')})")
        steps.append(f"""s{i} AS MATERIALIZED (SELECT cluster, list(m ORDER BY i) AS x FROM (
            SELECT cluster, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS m FROM (
                SELECT cluster, i, sum(e)::HUGEINT AS s, count(*) AS n FROM (
                    SELECT cluster, unnest(x) AS e, unnest(range({d})) AS i FROM a{i} JOIN v USING (rid)) GROUP BY cluster, i)) GROUP BY cluster)""")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(s.x, c.x) AS x FROM c{i} c LEFT JOIN s{i} s USING (cluster))")
    steps.append(f"a AS MATERIALIZED ({nearest(f'c{rounds}')})")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(x, ',')) AS centroid_sha256
        FROM a JOIN c{rounds} USING (cluster)"""


QUERIES = {f.__name__: f for f in (op1_quality_rules, quality_ablations, op2_language_id, op3_token_blocks, op4_simhash, op5_line_dedup, op6_streaming_bpe, op7_token_files, op8_quality_pu, op9_suffix_dedup, op10_decontaminate, op11_circulant_minhash, op12_spelling_variants, op13_centroid_clustering)}

ORACLE: dict[str, str] = {
    "op1_quality_rules": f"""
        WITH {_LEDGER}
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {quality_rules.POLICIES["base"]} <> 0 AS base_failed,
               fail_bits & {quality_rules.POLICIES[quality_rules.PRODUCTION]} = 0 AS kept, fail_bits
        FROM ledger
    """,
    "quality_ablations": f"""
        WITH {_LEDGER}, cells AS (SELECT * FROM (VALUES {_ABLATION_CELLS}) AS c(policy, rule, mask, bit))
        SELECT policy, rule, count(*) FILTER (fail_bits & mask & bit <> 0) AS failed, count(*) FILTER (fail_bits & mask = bit) AS alone,
               count(*) FILTER (fail_bits & mask = 0) AS kept, count(*) FILTER (fail_bits & mask & ~bit = 0) AS kept_without
        FROM ledger, cells GROUP BY policy, rule
    """,
    "op5_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
            FROM documents
        ), keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
        ), common AS (
            SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ), judged AS (
            SELECT keyed.*, coalesce(owner <> doc_id, false) AS gone FROM keyed LEFT JOIN common USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
    "op9_suffix_dedup": """
        WITH d AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), s AS (
            SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g
            FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)
        ), m AS (
            SELECT g, min(doc_id) AS first FROM s GROUP BY g HAVING min(doc_id) <> max(doc_id)
        ), hit AS (
            SELECT doc_id, i FROM s JOIN m USING (g) WHERE first < doc_id
        ), marked AS (
            SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, false) AS new FROM hit
        ), numbered AS (
            SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked
        ), runs AS (
            SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM numbered GROUP BY doc_id, run
        ), between_runs AS (
            SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM runs
        ), t AS (
            SELECT doc_id, sum(z - a)::BIGINT AS removed, count(*) AS spans, max(z) AS tail,
                   string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS head
            FROM between_runs JOIN d USING (doc_id) GROUP BY doc_id
        )
        SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
               sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN t USING (doc_id)
    """,
    "op11_circulant_minhash": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), s AS MATERIALIZED (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w
        ), n AS MATERIALIZED (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), both_in AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
        ), l AS MATERIALIZED (
            SELECT a, b FROM both_in i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i.n >= 80 * (x.n + y.n - i.n)
        ), e AS MATERIALIZED (
            SELECT a, b FROM l UNION ALL SELECT b, a FROM l
        ), r AS (
            SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
        ), c AS (
            SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a
        )
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
    "op13_centroid_clustering": kmeans_sql(centroid_clustering.CENTROIDS, centroid_clustering.ROUNDS, centroid_clustering.SEED, centroid_clustering.DIMENSIONS),
}
