"""SQL over the given tables that answers the named queries independently.

Written relationally (unnest, joins, window functions), where the library works
on arrays inside a row.
"""

from __future__ import annotations

import math

SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"

LINES = """lines AS (
 SELECT doc_id, lang, source, k, n, (3 * n + 3) // 4 AS cut, line FROM (
  SELECT doc_id, lang, source, line, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS k,
   CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS n FROM (
   SELECT doc_id, lang, source, pos, trim(line, ' ') AS line FROM (
    SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
     generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)) WHERE line <> ''))"""

PLACED = (
    LINES
    + rf""", placed0 AS (
 SELECT *, CASE WHEN k <= cut THEN 'main' ELSE 'comments' END AS section,
  CASE WHEN k <= cut THEN k ELSE k - cut END AS num,
  'https://example.org/' || (doc_id - (doc_id % 3) % 2) AS url,
  CASE WHEN (doc_id + k) % 11 = 0 THEN '# ' || line WHEN (doc_id + k) % 13 = 0 THEN 'TABLE: R: ' || line
   WHEN (doc_id + k) % 17 = 0 THEN 'CODE: ' || line WHEN (doc_id + k) % 7 = 0 THEN '> ' || line ELSE line END AS rendered
 FROM lines), placed AS (
 SELECT *, regexp_replace(rendered, '^{SPACE}+', '') AS text,
  regexp_matches(rendered, '^{SPACE}*(# |TABLE: |CODE: ).*[^ ]') AS structural FROM placed0)"""
)


def _ann(name: str, rater: int, bad: bool = False) -> str:
    """Annotations of one rater beside the lines."""
    medium = "CASE WHEN h < 3 THEN 'cannot_rate' WHEN h < 5 THEN 'transcribed' ELSE 'written' END"
    turn = "CASE WHEN h < 3 THEN NULL WHEN (doc_id * 13 + k) % 7 < 2 THEN 'dialogic' ELSE 'monologic' END"
    activity = (
        "CASE WHEN h < 3 THEN NULL ELSE CASE (doc_id * 7 + (k - k % 3) + bump) % 6 WHEN 0 THEN 'recounting' "
        "WHEN 1 THEN 'explaining' WHEN 2 THEN 'directing' WHEN 3 THEN 'evaluating' WHEN 4 THEN 'promoting' "
        "ELSE 'creating' END END"
    )
    formality = "CASE WHEN h < 3 THEN NULL WHEN (doc_id + k * 3 + bump) % 4 = 0 THEN 'informal' ELSE 'formal' END"
    if bad:
        medium = f"CASE WHEN (doc_id * 3 + k) % 23 = 0 THEN 'spoken' ELSE {medium} END"
        turn = f"CASE (doc_id + k) % 9 WHEN 0 THEN 'both' WHEN 1 THEN NULL ELSE {turn} END"
        activity = f"CASE (doc_id + k) % 8 WHEN 0 THEN 'news' WHEN 1 THEN NULL ELSE {activity} END"
        formality = f"CASE (doc_id + k) % 6 WHEN 0 THEN 'casual' WHEN 1 THEN NULL ELSE {formality} END"
    bump = f"CASE WHEN {rater} = 2 AND (doc_id + k) % 5 = 0 THEN 1 ELSE 0 END"
    empty, failed = ("20", "17") if rater == 1 else ("25", "19")
    return f"""{name} AS (
 SELECT doc_id, lang, source, k, n, cut, section, num, text, structural,
  CASE WHEN doc_id % {empty} = 0 THEN '' ELSE url END AS u, doc_id % {failed} = 0 AS failed,
  {medium} AS mode_medium, {turn} AS mode_turn, {activity} AS field_activity, {formality} AS tenor_formality
 FROM (SELECT *, {bump} AS bump, (doc_id * 31 + (k - k % 2) * 17 + 2 * {bump}) % 20 AS h FROM placed))"""


ANN1 = PLACED + ", " + _ann("a1", 1)
ANN2 = PLACED + ", " + _ann("a2", 2)
BOTH = ANN1 + ", " + _ann("a2", 2)
BAD = PLACED + ", " + _ann("a1", 1, True)

FACETS = ["mode_medium", "mode_turn", "field_activity", "tenor_formality"]


def _register(short: bool, default: str, p: str = "") -> str:
    names = (
        ["Narrative", "Info. description/explanation", "Opinion", "Info. persuasion", "How-to/instruct.", "Lyrical"]
        if short
        else [
            "Narrative",
            "Informational Description",
            "Opinion",
            "Informational Persuasion",
            "How-to or Instructional",
            "Lyrical",
        ]
    )
    acts = ["recounting", "explaining", "evaluating", "promoting", "directing", "creating"]
    cases = " ".join(f"WHEN '{a}' THEN '{n}'" for a, n in zip(acts, names))
    return (
        f"CASE WHEN {p}mode_medium = 'cannot_rate' THEN 'Cannot rate' WHEN {p}mode_medium = 'transcribed' THEN 'Spoken' "
        f"WHEN {p}mode_turn = 'dialogic' THEN 'Interactive Discussion' ELSE CASE {p}field_activity {cases} "
        f"ELSE {default} END END"
    )


LONG = _register(False, "'Cannot rate'")

SEGMENTS = (
    ANN1
    + f""", labelled AS (SELECT doc_id, lang, source, k, text, {LONG} AS label FROM a1),
 marked AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY doc_id ORDER BY k) THEN 0 ELSE 1 END AS start
  FROM labelled),
 runs AS (SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM marked),
 segs AS (SELECT doc_id, any_value(lang) AS lang, any_value(source) AS source, CAST(run - 1 AS INT) AS segment_idx,
  any_value(label) AS label, string_agg(text, ' ' ORDER BY k) AS text FROM runs GROUP BY doc_id, run)"""
)

COUNTS = (
    SEGMENTS
    + """, per_doc AS (
 SELECT any_value(lang) AS lang, least(count(DISTINCT label) FILTER (WHERE label <> 'Cannot rate'), 6) AS n_reg
 FROM segs GROUP BY doc_id),
 freq AS (SELECT lang, CAST(n_reg AS INT) AS n_reg, count(*) AS freq FROM per_doc GROUP BY ALL),
 shares AS (SELECT lang, n_reg, freq, CAST(freq AS DOUBLE) / sum(freq) OVER (PARTITION BY lang) AS share FROM freq)"""
)

MATCHED = (
    BOTH
    + """, l1 AS (SELECT u, max(doc_id) AS doc_id FROM a1 WHERE u <> '' GROUP BY u),
 l2 AS (SELECT u, max(doc_id) AS doc_id FROM a2 WHERE u <> '' GROUP BY u),
 pairs AS (SELECT l1.u, l1.doc_id AS d1, l2.doc_id AS d2 FROM l1 JOIN l2 USING (u)),
 common AS (SELECT pairs.u, d1, d2, x.section, x.num, x.text, x.mode_medium AS m1, y.mode_medium AS m2,
  x.mode_turn AS t1, y.mode_turn AS t2, x.field_activity AS f1, y.field_activity AS f2,
  x.tenor_formality AS o1, y.tenor_formality AS o2
  FROM pairs JOIN a1 x ON x.doc_id = d1 JOIN a2 y ON y.doc_id = d2 AND y.section = x.section AND y.num = x.num
  WHERE d1 % 17 <> 0 AND d2 % 19 <> 0),
 facets AS (SELECT u, section, num, 1 AS pos, 'mode_medium' AS field, m1 AS v1, m2 AS v2 FROM common
  UNION ALL SELECT u, section, num, 2, 'mode_turn', t1, t2 FROM common
  UNION ALL SELECT u, section, num, 3, 'field_activity', f1, f2 FROM common
  UNION ALL SELECT u, section, num, 4, 'tenor_formality', o1, o2 FROM common)"""
)

DISAGREEMENTS = (
    MATCHED
    + """, differing AS (SELECT u, section, num, string_agg(field || ':' || coalesce(v1, 'null') || '/' ||
   coalesce(v2, 'null'), ';' ORDER BY pos) AS facets FROM facets WHERE v1 IS DISTINCT FROM v2 GROUP BY ALL),
 shown AS (SELECT d.u, d.section, d.num AS line,
   CASE WHEN length(c.text) <= 500 THEN c.text ELSE substring(c.text, 1, 500) || '...' END AS text, d.facets
  FROM differing d JOIN common c ON c.u = d.u AND c.section = d.section AND c.num = d.num)"""
)

CELLS = (
    BOTH
    + f""", both_raters AS (SELECT a1.lang, a1.doc_id, a1.k, {', '.join(f'a2.{f} AS h_{f}, a1.{f} AS l_{f}' for f in FACETS)},
  {_register(True, 'NULL', 'a2.')} AS h_core, {_register(True, 'NULL', 'a1.')} AS l_core
  FROM a1 JOIN a2 ON a1.doc_id = a2.doc_id AND a1.k = a2.k),
 scored AS ({' UNION ALL '.join(
    f"SELECT lang, doc_id, k, '{name}' AS facet, h_{col} AS truth, l_{col} AS pred FROM both_raters"
    for name, col in [(f, f) for f in FACETS] + [('core_register', 'core')])}),
 cells AS (SELECT lang, facet, truth, pred, count(*) AS n FROM scored
  WHERE truth IS NOT NULL AND pred IS NOT NULL GROUP BY ALL)"""
)


def _report(by: list[str]) -> str:
    keys = ", ".join(by)
    return f"""truth_side AS (SELECT {keys}, truth AS label, sum(n) AS support,
   sum(CASE WHEN truth = pred THEN n ELSE 0 END) AS hits FROM cells GROUP BY {keys}, truth),
 pred_side AS (SELECT {keys}, pred AS label, sum(n) AS predicted FROM cells GROUP BY {keys}, pred),
 joined AS (SELECT {keys}, label, coalesce(support, 0) AS support, coalesce(hits, 0) AS hits,
   coalesce(predicted, 0) AS predicted FROM truth_side FULL JOIN pred_side USING ({keys}, label)),
 report AS (SELECT {keys}, label,
   CASE WHEN predicted > 0 THEN CAST(hits AS DOUBLE) / predicted ELSE 0 END AS precision,
   CASE WHEN support > 0 THEN CAST(hits AS DOUBLE) / support ELSE 0 END AS recall,
   CASE WHEN predicted + support > 0 THEN CAST(2 * hits AS DOUBLE) / (predicted + support) ELSE 0 END AS f1,
   CAST(support AS BIGINT) AS support FROM joined)"""


ACCURACY = """SELECT lang, facet, CAST(sum(n) AS BIGINT) AS n,
 CAST(sum(CASE WHEN truth = pred THEN n ELSE 0 END) AS BIGINT) AS correct,
 round(CAST(sum(CASE WHEN truth = pred THEN n ELSE 0 END) AS DOUBLE) / sum(n), 6) AS accuracy FROM cells GROUP BY ALL"""

REPORT_COLUMNS = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support"

CANDIDATES = ANN1 + ", keys AS (SELECT *, num - 1 AS line_idx FROM a1 WHERE NOT structural)"
KEY = "CASE WHEN mode_medium = 'cannot_rate' THEN 'cannot_rate|_' ELSE mode_medium || '|' || field_activity END"
DRAW = "md5('42|' || doc_id || '|' || section || '|' || line_idx)"

# Three rounds of proportional shares over the strata, then single leftovers in random order.
ALLOCATION = (
    CANDIDATES
    + f""", sizes AS (SELECT {KEY} AS stratum, count(*) AS size FROM keys GROUP BY 1),
 r0 AS (SELECT stratum, size, least(size, 5) AS alloc FROM sizes),
 b0 AS (SELECT 500 - sum(alloc) AS budget FROM r0),
 s0 AS (SELECT stratum, size, CASE WHEN budget < 0
   THEN greatest(1, CAST(round_even(CAST(alloc AS DOUBLE) * 500 / (SELECT sum(alloc) FROM r0), 0) AS BIGINT))
   ELSE alloc END AS alloc, greatest(budget, 0) AS budget FROM r0, b0)"""
    + "".join(
        f""", w{i} AS (SELECT *, size - alloc AS room, CASE WHEN size > alloc AND budget > 0
   THEN budget * (CAST(size - alloc AS DOUBLE) / sum(greatest(size - alloc, 0)) OVER ()) ELSE 0 END AS wanted FROM s{i - 1}),
 g{i} AS (SELECT *, least(CAST(floor(wanted) AS BIGINT), room) AS given FROM w{i}),
 s{i} AS (SELECT stratum, size, alloc + given AS alloc,
   CASE WHEN budget > 0 AND sum(greatest(room, 0)) OVER () > 0
    THEN CAST(round_even(sum(wanted - given) OVER (), 0) AS BIGINT) ELSE budget END AS budget FROM g{i})"""
        for i in (1, 2, 3)
    )
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY size > alloc
   ORDER BY md5('42|' || stratum), stratum) AS place FROM s3),
 allocated AS (SELECT stratum, size, CAST(alloc + CASE WHEN size > alloc AND place <= budget THEN 1 ELSE 0 END AS BIGINT)
   AS alloc FROM ranked)"""
)

TOKENS = (
    SEGMENTS
    + """, sents AS (SELECT doc_id, source, segment_idx, label, sent_pos, sent FROM (
  SELECT doc_id, source, segment_idx, label, unnest(string_split(text, '.')) AS raw,
   generate_subscripts(string_split(text, '.'), 1) AS sent_pos, trim(raw, ' ') AS sent FROM segs) WHERE sent <> ''),
 words AS (SELECT doc_id, source, segment_idx, label, sent_pos, w, CAST(row_number() OVER (
   PARTITION BY doc_id, segment_idx, sent_pos ORDER BY p) - 1 AS INT) AS j FROM (
  SELECT doc_id, source, segment_idx, label, sent_pos, unnest(string_split(sent || ' .', ' ')) AS w,
   generate_subscripts(string_split(sent || ' .', ' '), 1) AS p FROM sents) WHERE w <> ''),
 tokens AS (SELECT *, CASE WHEN length(w) % 8 = 0 THEN w ELSE lower(w) END AS lemma,
  CASE WHEN w = '.' THEN 'PUNCT' ELSE CASE (length(w) + j % 2) % 8 WHEN 0 THEN 'NOUN' WHEN 1 THEN 'VERB' WHEN 2 THEN 'DET'
   WHEN 3 THEN 'ADP' WHEN 4 THEN 'ADJ' WHEN 5 THEN 'NOUN' WHEN 6 THEN 'ADV' ELSE NULL END END AS upos,
  CASE WHEN w = '.' THEN NULL ELSE CASE length(w) % 4 WHEN 0 THEN ['Case=Nom', 'Number=Sing']
   WHEN 1 THEN ['Mood=Ind', 'Number=Plur', 'Tense=Past'] WHEN 2 THEN NULL ELSE ['Case=Acc'] END END AS feats,
  CASE WHEN j = 0 THEN 'root' WHEN w = '.' THEN 'punct' ELSE CASE (length(w) + j) % 5 WHEN 0 THEN 'nsubj'
   WHEN 1 THEN 'obj' WHEN 2 THEN 'nmod:poss' WHEN 3 THEN NULL ELSE 'advmod' END END AS deprel FROM words),
 sized AS (SELECT doc_id, source, segment_idx, any_value(label) AS label,
   count(*) FILTER (WHERE upos IS DISTINCT FROM 'PUNCT') AS n_tokens,
   count(DISTINCT sent_pos) FILTER (WHERE upos IS DISTINCT FROM 'PUNCT') AS n_sents
  FROM tokens GROUP BY doc_id, source, segment_idx),
 kept AS (SELECT * FROM sized WHERE label <> 'Cannot rate' AND n_tokens > 0)"""
)

TAGS = (
    TOKENS
    + """, tags AS (SELECT doc_id, segment_idx, 'upos' AS kind, coalesce(upos, 'X') AS tag FROM tokens
  UNION ALL SELECT doc_id, segment_idx, 'deprel', deprel FROM tokens WHERE deprel IS NOT NULL
  UNION ALL SELECT doc_id, segment_idx, 'feats', unnest(feats) FROM tokens),
 counts AS (SELECT doc_id, segment_idx, kind, tag, count(*) AS n FROM tags GROUP BY ALL)"""
)

WIDE_TAGS = (
    [("pos_" + t.lower(), "upos", t) for t in ["ADJ", "ADP", "ADV", "DET", "NOUN", "PUNCT", "VERB"]]
    + [
        ("dep_" + t.replace(":", "_"), "deprel", t)
        for t in ["advmod", "nmod:poss", "nsubj", "obj", "punct", "root"]
    ]
    + [
        ("morph_" + t.replace("=", "_"), "feats", t)
        for t in ["Case=Acc", "Case=Nom", "Mood=Ind", "Number=Plur", "Number=Sing", "Tense=Past"]
    ]
)


def _mattr(name: str, value: str) -> str:
    """Distinct types in every window of fifty content words, averaged."""
    return f"""{name}_w AS (SELECT doc_id, segment_idx, row_number() OVER s AS i, count(*) OVER (
    PARTITION BY doc_id, segment_idx) AS n, list({value}) OVER (PARTITION BY doc_id, segment_idx
    ORDER BY sent_pos, j ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS win
   FROM tokens WHERE upos IS DISTINCT FROM 'PUNCT' WINDOW s AS (PARTITION BY doc_id, segment_idx ORDER BY sent_pos, j)),
 {name} AS (SELECT doc_id, segment_idx, CASE WHEN any_value(n) < 50
    THEN CAST(max(CASE WHEN i = 1 THEN list_unique(win) END) AS DOUBLE) / any_value(n)
    ELSE CAST(sum(CASE WHEN i <= n - 49 THEN list_unique(win) END) AS DOUBLE) / 50.0::DOUBLE / (any_value(n) - 49) END AS {name} FROM {name}_w GROUP BY ALL)"""


EMBEDDINGS = """e AS (SELECT vec_id, 'reg' || label AS label, 'lang' || (vec_id % 4) AS lang,
 unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"""
NAME = "'e' || lpad(CAST(i AS VARCHAR), 2, '0')"
WIDE = ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i:02d}" for i in range(64))
SCORES = """scores AS (SELECT vec_id, 'reg' || label AS label, 'lang' || (vec_id % 4) AS lang,
 embedding[1]::DOUBLE AS F1, embedding[2]::DOUBLE AS F2 FROM embeddings)"""
ZMEANS = (
    SCORES
    + """, spread AS (SELECT lang, avg({f}) AS m, stddev_samp({f}) AS s FROM scores GROUP BY lang),
 z AS (SELECT lang, label, ({f} - m) / s AS z FROM scores JOIN spread USING (lang)),
 means AS (SELECT lang, label, count(*) AS n, avg(z) AS mean,
  CASE WHEN count(*) > 1 THEN stddev_samp(z) / sqrt(count(*)) ELSE 0 END AS se FROM z GROUP BY ALL)"""
)
MEAN_COLUMNS = """lang, label, n, round(mean, 6) AS mean, round(mean - 1.96::DOUBLE * se, 6) AS ci_lo,
 round(mean + 1.96::DOUBLE * se, 6) AS ci_hi"""

XML_OK = r"NOT regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]')"
ESCAPED = (
    "replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), "
    "'''', '&#x27;')"
)


def _blocks(kinds: list[tuple[str, str]], otherwise: str) -> str:
    cases = " ".join(f"WHEN (doc_id + k) % {m} = 0 THEN {sql}" for m, sql in kinds)
    return f"CASE {cases} ELSE {otherwise} END"


XML_BLOCK = _blocks(
    [
        ("11", "'<head>' || c || '</head>'"),
        ("13", "'<table><tr><th>' || c || '</th><td>k</td></tr><tr><td>' || c || '</td></tr></table>'"),
        ("17", "'<code>' || c || '</code>'"),
        ("7", "'<blockquote><p>' || c || '</p></blockquote>'"),
        ("5", "'<ul><li>' || c || '</li><li>b</li></ul>'"),
        ("19", "'<head>' || c || '</head>'"),
        ("23", "'<p>' || c || ' <code>f(x)</code>end</p>'"),
    ],
    "'<p>' || c || '</p>'",
)
MD_BLOCK = _blocks(
    [
        ("11", "'# ' || w"),
        ("13", "'TABLE: H: ' || w || ' | k ; R: ' || w"),
        ("17", "'CODE: ' || w"),
        ("7", "'> ' || w"),
        ("5", "'- ' || w || '; b'"),
        ("19", "'# ' || w"),
        ("23", "w || ' CODE: f(x)end'"),
    ],
    "w",
)
XML = (
    LINES
    + f""", good AS (SELECT doc_id FROM documents WHERE doc_id % 10 <> 7 AND {XML_OK}),
 blocks AS (SELECT doc_id, k, cut, regexp_replace(regexp_replace(regexp_replace({ESCAPED.format(x='line')},
   '[\\n\\r\\t ]+', ' ', 'g'), '^{SPACE}+|{SPACE}+$', '', 'g'), ' +', ' ', 'g') AS c,
  trim(regexp_replace(line, '{SPACE}+', ' ', 'g'), ' ') AS w FROM lines JOIN good USING (doc_id))"""
)

ORACLE: dict[str, str] = {}


def _add(name: str, sql: str) -> None:
    ORACLE[name] = sql


_add(
    "number_lines",
    f"""WITH {PLACED} SELECT doc_id,
 coalesce(string_agg('[' || num || '] ' || rendered, chr(10) ORDER BY num) FILTER (WHERE section = 'main'), '') AS markdown_main,
 coalesce(string_agg('[' || num || '] ' || rendered, chr(10) ORDER BY num) FILTER (WHERE section = 'comments'), '')
  AS markdown_comments FROM documents LEFT JOIN placed USING (doc_id) GROUP BY doc_id""",
)
_add("parse_lines", f"WITH {PLACED} SELECT doc_id, section, num - 1 AS line_idx, num, text FROM placed")
_add("structural_flag", f"WITH {PLACED} SELECT doc_id, section, num, structural FROM placed")
_add(
    "truncate_lines",
    f"""WITH {PLACED} SELECT doc_id, section, num,
 CASE WHEN length(text) <= 500 THEN text ELSE substring(text, 1, 500) || '...' END AS dots,
 CASE WHEN length(text) <= 120 THEN text ELSE substring(text, 1, 120) || '…' END AS ellipsis FROM placed""",
)
_add(
    "whitespace_normalise",
    f"SELECT page_id, trim(regexp_replace(html, '{SPACE}+', ' ', 'g'), ' ') AS text FROM pages",
)
_add(
    "escape_markup",
    f"SELECT page_id, regexp_replace({ESCAPED.format(x='html')}, '[\\n\\r\\t ]+', ' ', 'g') AS text FROM pages",
)
_add(
    "simplify_xml",
    f"""WITH {XML}, parts AS (SELECT doc_id, string_agg({XML_BLOCK}, ' ' ORDER BY k) FILTER (WHERE k <= cut) AS m,
  string_agg({XML_BLOCK}, ' ' ORDER BY k) FILTER (WHERE k > cut) AS c FROM blocks GROUP BY doc_id)
 SELECT doc_id, '<doc fingerprint="d' || doc_id || '"><main>' || m || '</main>' ||
  coalesce('<comments>' || c || '</comments>', '') || '</doc>' AS xml_simplified FROM parts""",
)
_add(
    "render_sections",
    f"""WITH {XML}, md AS (SELECT doc_id, k, cut, {MD_BLOCK} AS line FROM blocks)
 SELECT doc_id, string_agg('[' || k || '] ' || line, chr(10) ORDER BY k) FILTER (WHERE k <= cut) AS markdown_main,
  coalesce(string_agg('[' || (k - cut) || '] ' || line, chr(10) ORDER BY k) FILTER (WHERE k > cut), '') AS markdown_comments
 FROM md GROUP BY doc_id""",
)
_add(
    "written_and_skipped",
    f"""SELECT count(*) FILTER (WHERE doc_id % 10 <> 7 AND {XML_OK}) AS written,
 count(*) FILTER (WHERE doc_id % 10 = 7 OR NOT ({XML_OK})) AS skipped FROM documents""",
)
_VALID = {
    "mode_turn": ("'monologic', 'dialogic'", "'monologic'"),
    "field_activity": (
        "'recounting', 'explaining', 'directing', 'evaluating', 'promoting', 'creating'",
        "'explaining'",
    ),
    "tenor_formality": ("'formal', 'informal'", "'formal'"),
}
_VALIDATED = ", ".join(
    f"CASE WHEN mode_medium NOT IN ('written', 'transcribed') THEN NULL WHEN {f} IN ({ok}) THEN {f} ELSE {d} END AS {f}"
    for f, (ok, d) in _VALID.items()
)
_MEDIUM = "CASE WHEN mode_medium IN ('written', 'transcribed') THEN mode_medium ELSE 'cannot_rate' END AS mode_medium"
_add("label_validate", f"WITH {BAD} SELECT doc_id, section, num, {_MEDIUM}, {_VALIDATED} FROM a1")
_add(
    "invalid_labels",
    f"""WITH {BAD}, fixed AS (SELECT doc_id AS d, section AS s, num AS l, {_MEDIUM}, {_VALIDATED} FROM a1)
 SELECT section, count(*) FILTER (WHERE {' OR '.join(f'a1.{f} IS DISTINCT FROM fixed.{f}' for f in FACETS)}) AS repaired,
  count(*) AS n FROM a1 JOIN fixed ON doc_id = d AND section = s AND num = l GROUP BY section""",
)
_add(
    "comments_not_transcribed",
    """SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'written'
 WHEN (conv_id + turn + length(text)) % 3 = 0 THEN 'transcribed' ELSE 'written' END AS medium FROM conversations""",
)
_ANSWERED = (
    ANN1
    + """, sent AS (SELECT doc_id, num, mode_medium, row_number() OVER (PARTITION BY doc_id ORDER BY num DESC) AS back,
   count(*) OVER (PARTITION BY doc_id) AS total FROM a1 WHERE section = 'main' AND (doc_id + num) % 9 <> 4),
 received AS (SELECT doc_id, num, mode_medium FROM sent WHERE doc_id % 10 NOT IN (2, 4, 5, 6, 7) OR (doc_id % 10 = 2 AND back > 1)),
 folded AS (SELECT documents.doc_id, count(num) AS items, string_agg(num || ':' || mode_medium, ',' ORDER BY num) AS labels
  FROM documents LEFT JOIN received USING (doc_id) GROUP BY documents.doc_id),
 status AS (SELECT doc_id, CASE WHEN doc_id % 10 = 4 THEN 'unparsed' WHEN doc_id % 10 IN (5, 6) THEN 'broken'
  WHEN doc_id % 10 IN (1, 2) AND items = 0 THEN 'unparsed' ELSE 'ok' END AS status, items, labels FROM folded)"""
)
_add(
    "response_decode",
    f"""WITH {_ANSWERED} SELECT doc_id, status, CAST(items AS INT) AS items,
 CASE WHEN status = 'ok' THEN coalesce(labels, '') END AS labels FROM status""",
)
_add(
    "missing_lines",
    f"""WITH {_ANSWERED} SELECT doc_id, num FROM a1 JOIN status USING (doc_id) WHERE status = 'ok' AND section = 'main'
 AND NOT structural AND NOT EXISTS (SELECT 1 FROM received r WHERE r.doc_id = a1.doc_id AND r.num = a1.num)""",
)
_add(
    "registers_of_lines",
    f"WITH {BAD} SELECT doc_id, section, num, {_register(True, 'NULL')} AS short_name, {LONG} AS long_name FROM a1",
)


def _distribution(source: str, key: str) -> str:
    return f"""counts AS (SELECT {key} AS label, count(*) AS n FROM {source} GROUP BY 1)
 SELECT label, n, round(100.0::DOUBLE * n / (SELECT sum(n) FROM counts), 6) AS pct FROM counts
 UNION ALL SELECT 'TOTAL', CAST(sum(n) AS BIGINT), 100.0::DOUBLE FROM counts"""


_add("label_distribution", f"WITH {CANDIDATES}, {_distribution('keys', KEY)}")
_add(
    "strata_distribution",
    f"""WITH {BAD}, {_distribution('a1', '''CASE WHEN num % 12 = 0 THEN 'no_ann|none'
  WHEN mode_medium = 'cannot_rate' THEN 'cannot_rate|_' ELSE mode_medium || '|' || coalesce(field_activity, 'none') END''')
    .replace('FROM a1', 'FROM a1 WHERE NOT structural')}""",
)
_SUMMARY = """CASE WHEN mode_medium = 'cannot_rate' THEN 'cannot_rate' ELSE
 concat_ws(' | ', field_activity, mode_medium, mode_turn, tenor_formality) END AS summary"""
_add("facet_filter", f"WITH {ANN1} SELECT doc_id, section, num, {_SUMMARY} FROM a1 WHERE field_activity = 'promoting'")
_add("reviewable_lines", f"WITH {ANN1} SELECT doc_id, section, num, {_SUMMARY} FROM a1 WHERE mode_medium <> 'cannot_rate'")
_add(
    "next_match",
    f"""WITH {ANN1}, hits AS (SELECT doc_id FROM a1 WHERE section = 'comments' AND field_activity = 'creating')
 SELECT 'forward' AS way, coalesce(min(doc_id) FILTER (WHERE doc_id >= 77), min(doc_id)) AS doc_id FROM hits
 UNION ALL SELECT 'backward', coalesce(max(doc_id) FILTER (WHERE doc_id <= 77), max(doc_id)) FROM hits""",
)
_add("random_document", "SELECT doc_id, lang FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 1")
_add(
    "line_annotation_join",
    f"""WITH {ANN1} SELECT doc_id, section, num, CASE WHEN (doc_id + num) % 6 = 0 AND num % 4 <> 0 THEN 'again'
 WHEN (doc_id + num) % 10 <> 0 THEN mode_medium END AS medium FROM a1""",
)
_FAILED = "(doc_id % 10 = 3 OR (doc_id % 4 = 1 AND n > cut))"
_add("failed_documents", f"WITH {LINES} SELECT DISTINCT doc_id FROM lines WHERE {_FAILED}")
_add(
    "upsert_retry",
    f"""WITH {BOTH} SELECT doc_id, section, num, mode_medium AS medium, field_activity AS activity FROM a1 WHERE NOT {_FAILED}
 UNION ALL SELECT doc_id, section, num, mode_medium, field_activity FROM a2 WHERE {_FAILED}""",
)
_add(
    "chunk_prompts",
    f"""WITH {ANN1}, shown AS (SELECT *, '[' || num || '] ' || CASE WHEN length(text) <= 500 THEN text
   ELSE substring(text, 1, 500) || '...' END AS line FROM a1),
 openers AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY num) AS o FROM shown
   WHERE NOT structural AND regexp_matches(text, '[^ ]')) WHERE o <= 5),
 chunks AS (SELECT doc_id, section, any_value(u) AS u, (num - 1) // 15 * 15 AS b, max(num) AS e, min(num) AS f,
   bool_or(NOT structural) AS needed, string_agg(line || CASE WHEN structural THEN '  {{structural — do not classify}}' ELSE '' END,
   chr(10) ORDER BY num) AS target FROM shown GROUP BY doc_id, section, (num - 1) // 15 * 15),
 opening AS (SELECT c.doc_id, c.section, c.b, string_agg(o.line, chr(10) ORDER BY o.num) AS t FROM chunks c JOIN openers o
   ON o.doc_id = c.doc_id AND o.section = c.section AND (o.num <= c.b OR o.num > c.e) GROUP BY ALL),
 before AS (SELECT c.doc_id, c.section, c.b, string_agg(s.line, chr(10) ORDER BY s.num) AS t FROM chunks c JOIN shown s
   ON s.doc_id = c.doc_id AND s.section = c.section AND s.num BETWEEN c.b - 9 AND c.b GROUP BY ALL),
 behind AS (SELECT c.doc_id, c.section, c.b, string_agg(s.line, chr(10) ORDER BY s.num) AS t FROM chunks c JOIN shown s
   ON s.doc_id = c.doc_id AND s.section = c.section AND s.num BETWEEN c.e + 1 AND c.e + 10 GROUP BY ALL)
 SELECT c.doc_id, c.section, c.b AS "begin", c.e AS "end", 'URL: ' || u || chr(10) || 'Section: ' || c.section ||
  coalesce(chr(10) || chr(10) || '[DOCUMENT OPENING — for context only, do not classify]' || chr(10) || o.t, '') ||
  coalesce(chr(10) || chr(10) || '[CONTEXT — do not classify]' || chr(10) || p.t, '') ||
  chr(10) || chr(10) || '[CLASSIFY THESE LINES]' || chr(10) || c.target ||
  coalesce(chr(10) || chr(10) || '[CONTEXT — do not classify]' || chr(10) || q.t, '') AS prompt
 FROM chunks c LEFT JOIN opening o USING (doc_id, section, b) LEFT JOIN before p USING (doc_id, section, b)
 LEFT JOIN behind q USING (doc_id, section, b) WHERE needed""",
)
_add(
    "annotate_sections",
    f"""WITH {ANN1}, firsts AS (SELECT *, min(num) FILTER (WHERE NOT structural) OVER (
   PARTITION BY doc_id, section, (num - 1) // 15) AS opens FROM a1),
 gaps AS (SELECT *, NOT structural AND num % 9 = 4 AND num <> opens AS gap FROM firsts),
 asked AS (SELECT *, min(num) FILTER (WHERE gap) OVER (PARTITION BY doc_id, section, (num - 1) // 15) AS again FROM gaps),
 given AS (SELECT doc_id, section, num, CASE WHEN structural OR (gap AND num <> again) OR num % 5 = 0 THEN 'cannot_rate'
   WHEN num % 5 = 1 AND section = 'main' THEN 'transcribed' ELSE 'written' END AS mode_medium FROM asked)
 SELECT doc_id, section, num, mode_medium,
  CASE WHEN mode_medium <> 'cannot_rate' THEN CASE WHEN num % 2 = 0 THEN 'dialogic' ELSE 'monologic' END END AS mode_turn,
  CASE WHEN mode_medium <> 'cannot_rate' THEN CASE num % 6 WHEN 0 THEN 'recounting' WHEN 2 THEN 'directing'
    WHEN 3 THEN 'evaluating' ELSE 'explaining' END END AS field_activity,
  CASE WHEN mode_medium <> 'cannot_rate' THEN CASE WHEN num % 3 = 0 THEN 'informal' ELSE 'formal' END END AS tenor_formality
 FROM given""",
)
FILED = """filed AS (
 SELECT doc_id, path, row_number() OVER (PARTITION BY path ORDER BY doc_id) - 1 AS doc_idx, row_number() OVER (ORDER BY path, doc_id) - 1 AS doc_no
 FROM (SELECT doc_id, concat_ws('/', lang, source) AS path FROM documents))"""
_add("document_numbers", f"WITH {FILED} SELECT doc_id, path, doc_idx, doc_no FROM filed")
_add("label_range", f"WITH {FILED} SELECT doc_id, path, doc_idx, doc_no FROM filed WHERE doc_no >= 25 AND doc_id % 5 <> 2 ORDER BY doc_no LIMIT 100")
_add("resume_remaining", "SELECT doc_id, lang FROM documents WHERE doc_id % 17 = 0")
_add(
    "context_windows",
    f"""WITH {PLACED}, cutoff AS (SELECT *, CASE WHEN length(text) <= 500 THEN text ELSE substring(text, 1, 500) || '…' END AS t
   FROM placed), framed AS (SELECT doc_id, section, num, structural, t AS line_text,
  string_agg(num || ':' || t, chr(10)) OVER (PARTITION BY doc_id, section ORDER BY num ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b,
  string_agg(num || ':' || t, chr(10)) OVER (PARTITION BY doc_id, section ORDER BY num ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS a
  FROM cutoff) SELECT doc_id, section, num, line_text, coalesce(b, '') AS before, coalesce(a, '') AS after
 FROM framed WHERE NOT structural""",
)
_add("merge_runs", f"WITH {SEGMENTS} SELECT doc_id, segment_idx, label, text FROM segs")
_add("section_segments", f"WITH {ANN2} SELECT doc_id, section, {LONG} AS label, text FROM a2")
_add("register_count_shares", f"WITH {COUNTS} SELECT lang, n_reg, freq, round(share, 6) AS share FROM shares")
_add(
    "distinct_registers",
    f"""WITH {COUNTS}, grid AS (SELECT l.lang, b.n_reg, coalesce(s.share, 0) AS share FROM (SELECT DISTINCT lang FROM shares) l
  CROSS JOIN (SELECT DISTINCT n_reg FROM shares) b LEFT JOIN shares s ON s.lang = l.lang AND s.n_reg = b.n_reg)
 SELECT n_reg, round(avg(share), 6) AS mean, round(stddev_pop(share), 6) AS std FROM grid GROUP BY n_reg""",
)
_add(
    "length_vs_registers",
    f"""WITH {SEGMENTS} SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(count(DISTINCT label) AS INT) AS n_labels
 FROM segs GROUP BY doc_id""",
)
_add(
    "url_match_counts",
    f"""WITH {BOTH}, x AS (SELECT DISTINCT u FROM a1 WHERE u <> ''), y AS (SELECT DISTINCT u FROM a2 WHERE u <> '')
 SELECT count(*) FILTER (WHERE x.u IS NOT NULL AND y.u IS NOT NULL) AS matched,
  count(*) FILTER (WHERE y.u IS NULL) AS only_first, count(*) FILTER (WHERE x.u IS NULL) AS only_second
 FROM x FULL JOIN y ON x.u = y.u""",
)
_add(
    "compare_summary",
    f"""WITH {MATCHED} SELECT count(*) AS docs, count(*) FILTER (WHERE (d1 % 17 = 0) <> (d2 % 19 = 0)) AS one_failed,
 count(*) FILTER (WHERE d1 % 17 = 0 AND d2 % 19 = 0) AS both_failed, (SELECT count(*) FROM common) AS lines FROM pairs""",
)
_add(
    "facet_agreement",
    f"""WITH {MATCHED} SELECT field, count(*) FILTER (WHERE v1 IS NOT DISTINCT FROM v2) AS agree,
 count(*) FILTER (WHERE v1 IS DISTINCT FROM v2) AS disagree,
 round(100.0::DOUBLE * count(*) FILTER (WHERE v1 IS NOT DISTINCT FROM v2) / count(*), 6) AS pct FROM facets GROUP BY field""",
)
_add(
    "top_disagreements",
    f"""WITH {MATCHED}, c AS (SELECT field, v1, v2, count(*) AS n FROM facets WHERE v1 IS DISTINCT FROM v2 GROUP BY ALL),
 r AS (SELECT field, v1, v2, n, CAST(row_number() OVER (PARTITION BY field
  ORDER BY n DESC, v1 NULLS FIRST, v2 NULLS FIRST) AS INT) AS rank FROM c) SELECT * FROM r WHERE rank <= 10""",
)
_add("disagreement_lines", f"WITH {DISAGREEMENTS} SELECT u, section, line, text, facets FROM shown")
_add(
    "disagreement_examples",
    f"""WITH {DISAGREEMENTS} SELECT u, section, line, text, facets FROM shown
 ORDER BY u, CASE WHEN section = 'main' THEN 0 ELSE 1 END, line LIMIT 20""",
)
_add(
    "random_disagreements",
    f"""WITH {DISAGREEMENTS} SELECT u, section, line, text, facets FROM shown
 ORDER BY md5('5|' || u || '|' || section || '|' || line), u || '|' || section || '|' || line LIMIT 20""",
)
_SAME = " AND ".join(f"a1.{f} IS NOT DISTINCT FROM a2.{f}" for f in FACETS)
_add(
    "session_agreement",
    f"""WITH {BOTH} SELECT count(*) FILTER (WHERE {_SAME}) AS ag, count(*) FILTER (WHERE NOT ({_SAME})) AS dis, count(*) AS tot
 FROM a1 JOIN a2 ON a1.doc_id = a2.doc_id AND a1.k = a2.k WHERE a1.k % 2 = 1""",
)
_add(
    "prefilled_labels",
    f"""WITH {BAD} SELECT doc_id, k AS line_no, mode_medium,
 {', '.join(f"CASE WHEN mode_medium <> 'cannot_rate' THEN {f} END AS {f}" for f in FACETS[1:])} FROM a1""",
)
_add("accuracy_by_language", f"WITH {CELLS} {ACCURACY}")
_add(
    "class_report",
    f"WITH {CELLS}, {_report(['lang', 'facet'])} SELECT lang, facet, label, {REPORT_COLUMNS} FROM report",
)
_add("pooled_class_report", f"WITH {CELLS}, {_report(['facet'])} SELECT facet, label, {REPORT_COLUMNS} FROM report")
_add(
    "report_averages",
    f"""WITH {CELLS}, {_report(['facet'])} SELECT facet,
 {', '.join(f'round(avg({m}), 6) AS macro_{m}' for m in ('precision', 'recall', 'f1'))},
 {', '.join(f'round(sum({m} * support) / sum(support), 6) AS weighted_{m}' for m in ('precision', 'recall', 'f1'))},
 CAST(sum(support) AS BIGINT) AS support FROM report GROUP BY facet""",
)
_GRID = """labels AS (SELECT {k}, truth AS label FROM cells UNION SELECT {k}, pred FROM cells),
 grid AS (SELECT {p}, t.label AS truth, p.label AS pred, coalesce((SELECT sum(c.n) FROM cells c
   WHERE {w} AND c.truth = t.label AND c.pred = p.label), 0) AS n FROM labels t JOIN labels p USING ({k}))"""
_add(
    "confusion_matrix",
    f"""WITH {CELLS}, {_GRID.format(k='lang, facet', p='lang, facet', w='c.lang = t.lang AND c.facet = t.facet')}
 SELECT lang, facet, truth, pred, CAST(n AS BIGINT) AS n FROM grid""",
)
_add(
    "confusion_matrix_text",
    f"""WITH {CELLS}, {_GRID.format(k='facet', p='facet', w='c.facet = t.facet')},
 wide AS (SELECT facet, CAST(greatest(max(length(label)) + 2, 8) AS INT) AS w FROM labels GROUP BY facet),
 header AS (SELECT facet, repeat(' ', any_value(w)) || '  ' || string_agg(lpad(label, w, ' '), '  ' ORDER BY label) AS h
  FROM labels JOIN wide USING (facet) GROUP BY facet),
 body AS (SELECT facet, truth, lpad(truth, any_value(w), ' ') || '  ' ||
   string_agg(lpad(CAST(CAST(n AS BIGINT) AS VARCHAR), w, ' '), '  ' ORDER BY pred) AS line
  FROM grid JOIN wide USING (facet) GROUP BY facet, truth)
 SELECT facet, any_value(h) || chr(10) || string_agg(line, chr(10) ORDER BY truth) AS text
 FROM body JOIN header USING (facet) GROUP BY facet""",
)
_FACET_ACC = """facet_acc AS (SELECT lang, sum(n) AS n, sum(CASE WHEN truth = pred THEN n ELSE 0 END) AS c FROM cells
 WHERE facet <> 'core_register' GROUP BY lang, facet)"""
_add(
    "overall_accuracy",
    f"""WITH {CELLS}, {_FACET_ACC} SELECT lang, CAST(sum(n) AS BIGINT) AS n, round(CAST(sum(c) AS DOUBLE) / sum(n), 6) AS exact,
 round(sum(floor(CAST(c AS DOUBLE) / n * n)) / sum(n), 6) AS truncated FROM facet_acc GROUP BY lang""",
)
_add(
    "pooled_accuracy",
    f"""WITH {CELLS}, {_FACET_ACC}, acc AS (SELECT 'overall' AS measure, CAST(sum(c) AS DOUBLE) / sum(n) AS a FROM facet_acc GROUP BY lang
  UNION ALL SELECT 'core_register', CAST(sum(CASE WHEN truth = pred THEN n ELSE 0 END) AS DOUBLE) / sum(n) FROM cells
   WHERE facet = 'core_register' GROUP BY lang)
 SELECT measure, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std, count(*) AS langs FROM acc GROUP BY measure""",
)
_add(
    "capped_evaluation",
    f"""WITH {CELLS.replace('a1.lang, a1.doc_id', "CASE WHEN a1.lang = 'es' THEN 'swe_Latn' ELSE a1.lang END AS lang, a1.doc_id")
    .split(' cells AS (')[0]} ordered AS (SELECT *, row_number() OVER (PARTITION BY lang, facet ORDER BY doc_id, k) AS r
  FROM scored), cells AS (SELECT lang, facet, truth, pred, count(*) AS n FROM ordered WHERE r <= CASE WHEN lang = 'swe_Latn'
  THEN 100 ELSE 250 END AND truth IS NOT NULL AND pred IS NOT NULL GROUP BY ALL) {ACCURACY}""",
)
_add(
    "sample_simple",
    f"""WITH {CANDIDATES}, drawn AS (SELECT *, {DRAW} AS d FROM keys ORDER BY d, doc_id, section, line_idx LIMIT 500)
 SELECT row_number() OVER (ORDER BY d, doc_id, section, line_idx) - 1 AS task_id, doc_id, section, num AS line_num FROM drawn""",
)
_add("stratum_allocation", f"WITH {ALLOCATION} SELECT stratum, size, alloc FROM allocated")
_add(
    "sample_stratified",
    f"""WITH {ALLOCATION}, placed_in AS (SELECT *, {KEY} AS stratum, {DRAW} AS d FROM keys),
 numbered AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY d, doc_id, section, line_idx) AS r FROM placed_in),
 drawn AS (SELECT numbered.* FROM numbered JOIN allocated USING (stratum) WHERE r <= alloc)
 SELECT row_number() OVER (ORDER BY md5('order|' || d), doc_id, section, line_idx) - 1 AS task_id, doc_id, section,
  num AS line_num, stratum FROM drawn""",
)
_add(
    "sampled_tasks",
    f"""WITH {CANDIDATES}, drawn AS (SELECT *, {DRAW} AS d FROM keys ORDER BY d, doc_id, section, line_idx LIMIT 500)
 SELECT row_number() OVER (ORDER BY d, doc_id, section, line_idx) - 1 AS task_id, doc_id AS doc_idx, section, u AS url,
  line_idx, num AS line_num, CASE WHEN length(text) <= 500 THEN text ELSE substring(text, 1, 500) || '…' END AS line_text,
  least(line_idx, 5) AS n_before,
  least(CASE WHEN section = 'main' THEN cut ELSE n - cut END - num, 5) AS n_after, field_activity AS activity FROM drawn""",
)
_add(
    "morphology_pairs",
    f"""WITH {TOKENS}, p AS (SELECT unnest(feats) AS kv FROM tokens)
 SELECT split_part(kv, '=', 1) AS key, split_part(kv, '=', 2) AS value, count(*) AS n FROM p GROUP BY ALL""",
)
_add("tag_vocabulary", f"WITH {TAGS} SELECT DISTINCT kind, tag FROM tags WHERE tag <> 'X'")
_add(
    "tag_rates_long",
    f"""WITH {TAGS} SELECT doc_id, segment_idx, kind, tag, CAST(n AS INT) AS n, round(1000.0::DOUBLE * n / n_tokens, 6) AS rate
 FROM counts JOIN kept USING (doc_id, segment_idx)""",
)
_add(
    "tag_rates_wide",
    f"""WITH {TAGS} SELECT doc_id, segment_idx, {', '.join(
        f"round(1000.0::DOUBLE * coalesce(sum(n) FILTER (WHERE kind = '{k}' AND tag = '{t}'), 0) / any_value(n_tokens), 6) AS {c}"
        for c, k, t in WIDE_TAGS)} FROM counts JOIN kept USING (doc_id, segment_idx) GROUP BY doc_id, segment_idx""",
)
_add(
    "structural_means",
    f"""WITH {TOKENS}, {_mattr('mattr50_words', 'lower(w)')}, {_mattr('mattr50_lemmas', 'lower(lemma)')},
 plain AS (SELECT doc_id, segment_idx, avg(abs(j - (j + 1))) FILTER (WHERE j > 0) AS dist,
  avg(length(w)) FILTER (WHERE upos IS DISTINCT FROM 'PUNCT') AS wlen FROM tokens GROUP BY ALL)
 SELECT doc_id, segment_idx, label, n_tokens, n_sents,
  round(CAST(n_tokens AS DOUBLE) / n_sents, 6) AS mean_sent_len, round(coalesce(dist, 0), 6) AS mean_dep_dist,
  round(wlen, 6) AS mean_word_len, round(mattr50_words, 6) AS mattr50_words, round(mattr50_lemmas, 6) AS mattr50_lemmas
 FROM kept JOIN plain USING (doc_id, segment_idx) JOIN mattr50_words USING (doc_id, segment_idx)
 JOIN mattr50_lemmas USING (doc_id, segment_idx)""",
)
_add(
    "token_stats",
    f"""WITH {TOKENS} SELECT source, label, count(*) AS segments, min(n_tokens) AS min_tokens,
 CAST(floor(quantile_cont(CAST(n_tokens AS DOUBLE), 0.5)) AS BIGINT) AS median_tokens, max(n_tokens) AS max_tokens
 FROM kept GROUP BY source, label""",
)
_add(
    "variance_filter",
    f"""WITH {EMBEDDINGS} SELECT {NAME} AS feature, round(stddev_samp(v), 6) AS std, stddev_samp(v) >= 1e-6 AS kept
 FROM e GROUP BY i UNION ALL SELECT 'flat', 0.0::DOUBLE, false
 UNION ALL SELECT 'near', round(stddev_samp(v * 1e-8), 6), stddev_samp(v * 1e-8) >= 1e-6 FROM e WHERE i = 0""",
)
_add(
    "log_rates",
    "SELECT vec_id, "
    + ", ".join(f"round(ln(1 + greatest(embedding[{i + 1}]::DOUBLE, 0)), 6) AS e{i:02d}" for i in range(64))
    + " FROM embeddings",
)
_add(
    "zscore_columns",
    f"WITH w AS (SELECT vec_id, {WIDE} FROM embeddings) SELECT vec_id, "
    + ", ".join(f"round((e{i:02d} - avg(e{i:02d}) OVER ()) / stddev_samp(e{i:02d}) OVER (), 6) AS e{i:02d}" for i in range(64))
    + " FROM w",
)
_add(
    "correlation_pairs",
    f"""WITH {EMBEDDINGS}, named AS (SELECT vec_id, {NAME} AS name, v FROM e)
 SELECT x.name AS a, y.name AS b, round(corr(x.v, y.v), 6) AS r FROM named x JOIN named y ON x.vec_id = y.vec_id AND x.name < y.name
 GROUP BY ALL""",
)
# --- Linear algebra as relations: matrices are (i, j, v), eliminations and powers are recursions.

CORR = f"""{EMBEDDINGS}, corr AS MATERIALIZED (
 SELECT x.i, y.i AS j, CASE WHEN x.i = y.i THEN 1.0 ELSE corr(x.v, y.v) END AS v FROM e x JOIN e y USING (vec_id) GROUP BY x.i, y.i),
 size AS (SELECT count(DISTINCT vec_id) AS n, count(DISTINCT i)::BIGINT AS p FROM e)"""
# Gauss-Jordan elimination: after the sweep on all pivots the matrix is the negative inverse, and the pivots multiply to the determinant.
SWEEP = """sweep AS (SELECT 0::BIGINT AS k, i::BIGINT AS i, j::BIGINT AS j, v FROM corr UNION ALL
 SELECT a.k + 1, a.i, a.j, CASE WHEN a.i = a.k AND a.j = a.k THEN -1 / p.v WHEN a.i = a.k OR a.j = a.k THEN a.v / p.v ELSE a.v - r.v * c.v / p.v END
 FROM sweep a JOIN sweep p ON p.i = a.k AND p.j = a.k JOIN sweep r ON r.i = a.i AND r.j = a.k JOIN sweep c ON c.i = a.k AND c.j = a.j
 WHERE a.k < (SELECT p FROM size)),
 inverse AS MATERIALIZED (SELECT i, j, -v AS v FROM sweep WHERE k = (SELECT p FROM size)),
 logdet AS (SELECT sum(ln(v)) AS v FROM sweep WHERE i = j AND i = k),
 smc AS (SELECT i, 1 - 1 / greatest(v, 1.0) AS v FROM inverse WHERE i = j)"""
# The strongest pair left settles first; of it the column varying less goes.
_add(
    "vector_collinear",
    f"""WITH RECURSIVE {CORR}, sd AS (SELECT i, stddev_samp(v) AS s FROM e GROUP BY i),
 pairs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY abs(v) DESC, c.i DESC, c.j DESC) AS t, c.i AS a, c.j AS b, x.s < y.s AS first_goes
  FROM corr c JOIN sd x ON x.i = c.i JOIN sd y ON y.i = c.j WHERE c.i < c.j AND abs(v) > 0.1),
 state AS (SELECT 0::BIGINT AS t, []::BIGINT[] AS gone UNION ALL
  SELECT p.t, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN gone ELSE list_append(gone, CASE WHEN first_goes THEN a ELSE b END) END
  FROM state s JOIN pairs p ON p.t = s.t + 1),
 last AS (SELECT gone FROM state ORDER BY t DESC LIMIT 1)
 SELECT {NAME} AS feature, NOT list_contains(gone, i) AS kept FROM (SELECT DISTINCT i FROM e), last""",
)
_add("vector_smc", f"WITH RECURSIVE {CORR}, {SWEEP} SELECT {NAME} AS feature, round(v, 6) AS smc FROM smc")
_add("vector_screened", f"WITH RECURSIVE {CORR}, {SWEEP} SELECT {NAME} AS feature, v >= median(v) OVER () AS kept FROM smc")
_add(
    "vector_adequacy",
    f"""WITH RECURSIVE {CORR}, {SWEEP},
 terms AS (SELECT c.i, sum(c.v * c.v) AS simple, sum(q.v * q.v / (x.v * y.v)) AS part FROM corr c JOIN inverse q USING (i, j)
  JOIN inverse x ON x.i = c.i AND x.j = c.i JOIN inverse y ON y.i = c.j AND y.j = c.j WHERE c.i <> c.j GROUP BY c.i)
 SELECT 'chi2' AS measure, round(-(n - 1 - (2 * p + 5) / 6.0::DOUBLE) * v, 4) AS value FROM size, logdet
 UNION ALL SELECT 'df', p * (p - 1) / 2.0::DOUBLE FROM size
 UNION ALL SELECT 'kmo', round(sum(simple) / (sum(simple) + sum(part)), 6) FROM terms
 UNION ALL SELECT 'kmo:' || {NAME}, round(simple / (simple + part), 6) FROM terms""",
)


def _eigen(k: int, squarings: int = 14) -> str:
    """Leading eigenvectors by squaring (a power of 2 ** squarings, scaled at each step) and deflation."""
    parts, m = [], "corr"
    for f in range(1, k + 1):
        step = m
        for s in range(squarings):
            name = f"q{f}_{s}"
            parts.append(
                f"""{name} AS MATERIALIZED (SELECT i, j, v / max(abs(v)) OVER () AS v FROM (
 SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {step} a JOIN {step} b ON a.j = b.i GROUP BY a.i, b.j))"""
            )
            step = name
        # Every column of the power points along the eigenvector; the longest does so best.
        parts.append(
            f"""u{f} AS MATERIALIZED (SELECT i, v / sqrt(sum(v * v) OVER ()) AS v FROM {step}
 WHERE j = (SELECT j FROM {step} GROUP BY j ORDER BY sum(v * v) DESC, j LIMIT 1))"""
        )
        parts.append(f"l{f} AS MATERIALIZED (SELECT sum(x.v * c.v * y.v) AS v FROM {m} c JOIN u{f} x ON x.i = c.i JOIN u{f} y ON y.i = c.j)")
        parts.append(f"m{f} AS MATERIALIZED (SELECT c.i, c.j, c.v - l{f}.v * x.v * y.v AS v FROM {m} c JOIN u{f} x ON x.i = c.i JOIN u{f} y ON y.i = c.j, l{f})")
        m = f"m{f}"
    return ", ".join(parts)


# Two factors: the angle of varimax has a closed form, and promax is a regression of two unknowns.
SOLUTION = f"""{_eigen(2)},
 raw AS (SELECT i, u1.v * sqrt(l1.v) AS a, u2.v * sqrt(l2.v) AS b FROM u1 JOIN u2 USING (i), l1, l2),
 unit AS (SELECT i, h, a / h AS x, b / h AS y FROM (SELECT *, sqrt(a * a + b * b) AS h FROM raw)),
 angle AS (SELECT atan2(2 * (sum(u * w) - sum(u) * sum(w) / count(*)), sum(u * u - w * w) - (sum(u) * sum(u) - sum(w) * sum(w)) / count(*)) / 4 AS t
  FROM (SELECT x * x - y * y AS u, 2 * x * y AS w FROM unit)),
 turned AS (SELECT i, h, x * cos(t) + y * sin(t) AS x, y * cos(t) - x * sin(t) AS y FROM unit, angle),
 target AS (SELECT *, x * abs(x) * x * x AS p, y * abs(y) * y * y AS q FROM turned),
 normal AS (SELECT sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, sum(x * p) AS xp, sum(y * p) AS yp, sum(x * q) AS xq, sum(y * q) AS yq FROM target),
 map AS (SELECT (yy * xp - xy * yp) / d AS a, (yy * xq - xy * yq) / d AS b, (xx * yp - xy * xp) / d AS c, (xx * yq - xy * xq) / d AS e
  FROM (SELECT *, xx * yy - xy * xy AS d FROM normal)),
 scaled AS (SELECT a * s AS a, b * r AS b, c * s AS c, e * r AS e FROM (
  SELECT *, sqrt((b * b + e * e) / power(a * e - b * c, 2)) AS s, sqrt((a * a + c * c) / power(a * e - b * c, 2)) AS r FROM map)),
 phi0 AS (SELECT -(e * c + b * a) / power(a * e - b * c, 2) AS v FROM scaled),
 pattern0 AS (SELECT i, h * (x * a + y * c) AS x, h * (x * b + y * e) AS y FROM turned, scaled),
 signs AS (SELECT CASE WHEN sum(x) < 0 THEN -1 ELSE 1 END AS sx, CASE WHEN sum(y) < 0 THEN -1 ELSE 1 END AS sy FROM pattern0),
 pattern AS MATERIALIZED (SELECT i, x * sx AS x, y * sy AS y FROM pattern0, signs),
 phi AS (SELECT v * sx * sy AS v FROM phi0, signs)"""
_add("vector_loadings", f"WITH {CORR}, {SOLUTION} SELECT {NAME} AS feature, round(x, 5) AS F1, round(y, 5) AS F2 FROM pattern")
_add("vector_communalities", f"WITH {CORR}, {SOLUTION} SELECT {NAME} AS feature, round(x * x + y * y, 5) AS communality FROM pattern")
_add(
    "vector_variance",
    f"""WITH {CORR}, {SOLUTION}, s AS (SELECT sum(x * x) AS a, sum(y * y) AS b, count(*) AS p FROM pattern)
 SELECT 'F1' AS factor, round(a, 5) AS SS_loadings, round(a / p, 5) AS proportion_var, round(a / p, 5) AS cumulative_var FROM s
 UNION ALL SELECT 'F2', round(b, 5), round(b / p, 5), round((a + b) / p, 5) FROM s""",
)
_add(
    "vector_factor_correlations",
    f"""WITH {CORR}, {SOLUTION} SELECT 'F1' AS factor, 1.0::DOUBLE AS F1, round(v, 5) AS F2 FROM phi
 UNION ALL SELECT 'F2', round(v, 5), 1.0::DOUBLE FROM phi""",
)
_add(
    "vector_scores",
    f"""WITH RECURSIVE {CORR}, {SWEEP}, {SOLUTION},
 structure AS (SELECT i, x + y * v AS x, x * v + y AS y FROM pattern, phi),
 weights AS (SELECT q.i, sum(q.v * s.x) AS x, sum(q.v * s.y) AS y FROM inverse q JOIN structure s ON s.i = q.j GROUP BY q.i),
 z AS (SELECT vec_id, i, (v - avg(v) OVER (PARTITION BY i)) / stddev_pop(v) OVER (PARTITION BY i) AS v FROM e)
 SELECT vec_id, round(sum(z.v * x), 4) AS F1, round(sum(z.v * y), 4) AS F2 FROM z JOIN weights USING (i) GROUP BY vec_id""",
)


LIMITS = [int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(12)]
_add(
    "bootstrap_intervals",
    f"""WITH {SCORES}, words AS (SELECT label, F1 AS v, ('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT AS a, ('0x' || substr(md5(vec_id::VARCHAR), 9, 8))::BIGINT AS b FROM scores),
 c0 AS (SELECT r, (r * {0x1F123BB5}) & 4294967295 AS x FROM (SELECT unnest(range(2000)) AS r)),
 c1 AS (SELECT r, (xor(x, x >> 16) * {0x21F0AAAD}) & 4294967295 AS x FROM c0), c2 AS (SELECT r, (xor(x, x >> 15) * {0x735A2D97}) & 4294967295 AS x FROM c1),
 c AS (SELECT r, xor(x, x >> 15) AS c FROM c2),
 d0 AS (SELECT label, v, b, r, xor(a, c) AS x FROM words, c),
 d1 AS (SELECT label, v, b, r, (xor(x, x >> 16) * {0x21F0AAAD}) & 4294967295 AS x FROM d0), d2 AS (SELECT label, v, b, r, (xor(x, x >> 15) * {0x735A2D97}) & 4294967295 AS x FROM d1),
 d3 AS (SELECT label, v, r, xor(xor(x, x >> 15), b) AS x FROM d2),
 d4 AS (SELECT label, v, r, (xor(x, x >> 16) * {0x21F0AAAD}) & 4294967295 AS x FROM d3), d5 AS (SELECT label, v, r, (xor(x, x >> 15) * {0x735A2D97}) & 4294967295 AS x FROM d4),
 drawn AS (SELECT label, v, r, {' + '.join(f'(xor(x, x >> 15) >= {t})::INT' for t in LIMITS)} AS w FROM d5),
 means AS (SELECT label, r, sum(w * v) / nullif(sum(w), 0) AS m FROM drawn GROUP BY label, r),
 sizes AS (SELECT label, count(*) AS n FROM scores GROUP BY label)
 SELECT label, any_value(n) AS n, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM means JOIN sizes USING (label) GROUP BY label""",
)
_LOADINGS = (
    EMBEDDINGS
    + """, loadings AS (SELECT label AS feature, 'F' || (i + 1) AS factor, round(10 * avg(v), 6) AS loading
 FROM e GROUP BY label, i)"""
)
_add(
    "salient_poles",
    f"""WITH {_LOADINGS} SELECT factor, CASE WHEN loading > 0 THEN '+' ELSE '-' END AS pole, feature, loading
 FROM loadings WHERE abs(loading) >= 0.2::DOUBLE""",
)
_add(
    "loading_diagnostics",
    f"""WITH {_LOADINGS}, f AS (SELECT factor, count(*) FILTER (WHERE abs(loading) >= 0.2::DOUBLE) AS size FROM loadings GROUP BY factor),
 r AS (SELECT feature, count(*) FILTER (WHERE abs(loading) >= 0.2::DOUBLE) AS hits FROM loadings GROUP BY feature)
 SELECT (SELECT count(*) FROM f WHERE size >= 3) AS interpretable_factors, (SELECT min(size) FROM f) AS min_factor_size,
  (SELECT string_agg(size, ',' ORDER BY CAST(substr(factor, 2) AS INT)) FROM f) AS feats_per_factor,
  (SELECT count(*) FROM r WHERE hits >= 1) AS salient_features, (SELECT count(*) FROM r WHERE hits >= 2) AS complex_features""",
)
_INTERVAL = ", ".join(
    f"""round(avg({f}), 6) AS mean_{f}, round(avg({f}) - 1.96::DOUBLE * stddev_samp({f}) / sqrt(count(*)), 6) AS lo_{f},
 round(avg({f}) + 1.96::DOUBLE * stddev_samp({f}) / sqrt(count(*)), 6) AS hi_{f}"""
    for f in ("F1", "F2")
)
_add(
    "centroid_intervals",
    f"WITH {SCORES} SELECT lang, label, count(*) AS n, {_INTERVAL} FROM scores GROUP BY lang, label HAVING count(*) >= 2",
)
_COLOURS = "'#e6194b', '#3cb44b', '#4363d8', '#f58231', '#911eb4', '#42d4f4', '#f032e6', '#9A6324', '#469990', '#800000'"
_add(
    "styled_centroids",
    f"""WITH {SCORES}, m AS (SELECT label, round(avg(F1), 6) AS mean_F1 FROM scores GROUP BY label)
 SELECT label, mean_F1, [{_COLOURS}][row_number() OVER (ORDER BY label)] AS colour FROM m""",
)
_add(
    "raw_register_means",
    f"""WITH {SCORES}, means AS (SELECT lang, label, count(*) AS n, avg(F1) AS mean, CASE WHEN count(*) > 1
  THEN stddev_samp(F1) / sqrt(count(*)) ELSE 0 END AS se FROM scores GROUP BY ALL) SELECT {MEAN_COLUMNS} FROM means""",
)
_add("znorm_register_means", f"WITH {ZMEANS.format(f='F1')} SELECT {MEAN_COLUMNS} FROM means")
_add(
    "register_order",
    f"""WITH {ZMEANS.format(f='F1')}, o AS (SELECT label, avg(mean) AS key FROM means GROUP BY label)
 SELECT label, CAST(row_number() OVER (ORDER BY key, label) - 1 AS INT) AS position FROM o""",
)
_add(
    "dimension_comparison",
    f"""WITH {ZMEANS.format(f='F2')}, o AS (SELECT label AS reg, CAST(row_number() OVER (ORDER BY mean, label) - 1 AS INT) AS position
  FROM means WHERE lang = 'lang1') SELECT position, {MEAN_COLUMNS} FROM means JOIN o ON label = reg""",
)
_PREFIX = "CASE lang WHEN 'de' THEN 'cmn_Hans' WHEN 'en' THEN 'eng_Latn' WHEN 'fr' THEN 'cmn_Hant' ELSE 'FIN_latn' END"
_add(
    "file_language_map",
    f"""WITH f AS (SELECT {_PREFIX} AS p FROM documents) SELECT CASE lower(p) WHEN 'cmn_hans' THEN 'zh' WHEN 'cmn_hant' THEN 'zh'
  WHEN 'eng_latn' THEN 'en' WHEN 'fin_latn' THEN 'fi' END AS parser, CASE WHEN p LIKE 'cmn%' THEN 'cmn' ELSE p END AS merge_group,
  p AS source_tag, CASE p WHEN 'cmn_Hans' THEN 'Mandarin' WHEN 'cmn_Hant' THEN 'Mandarin' WHEN 'eng_Latn' THEN 'English'
  ELSE 'unknown' END AS language, count(*) AS docs FROM f GROUP BY ALL""",
)
_SEGMENTS2 = SEGMENTS.replace(_ann("a1", 1), _ann("a1", 2))
_add(
    "concat_sources",
    f"""SELECT doc_id, segment_idx, source, n_chars FROM (
 WITH {SEGMENTS} SELECT doc_id, segment_idx, 'rater1' AS source, CAST(length(text) AS INT) AS n_chars FROM segs)
 UNION ALL SELECT doc_id, segment_idx, source, n_chars FROM (
 WITH {_SEGMENTS2} SELECT doc_id, segment_idx, 'rater2' AS source, CAST(length(text) AS INT) AS n_chars FROM segs)""",
)
_add(
    "one_to_one_check",
    """SELECT (SELECT count(*) FROM documents) AS inputs, (SELECT count(*) FROM labels) AS outputs,
 count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, count(*) FILTER (WHERE d.doc_id IS NULL) AS "foreign"
 FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""",
)
_add(
    "text_fingerprint",
    f"""WITH t AS (SELECT doc_id, regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') AS x FROM documents),
 h AS (SELECT doc_id, length(x) AS n, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(x, ''), lambda c:
   unicode(c)::BIGINT)), lambda a, c: (a * 33 + c) % 4294967296) AS h FROM t)
 SELECT doc_id, lower(to_base(n, 36)) || '_' || lower(to_base(h, 36)) AS fingerprint FROM h""",
)
_add(
    "task_caps",
    """SELECT CASE WHEN lang = 'es' THEN 'swe_Latn' ELSE lang END AS lang,
 least(count(*), CASE WHEN lang = 'es' THEN 100 ELSE 250 END) AS cap FROM documents GROUP BY lang""",
)
