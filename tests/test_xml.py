"""XML simplification and line rendering."""

import pyarrow as pa
import pytest

from registrum.operators import xmltext

DOC = (
    '<doc fingerprint="a&amp;b" x="1"><main><p><hi rend="#b">Title</hi></p><p>Hi <hi rend="#i">there</hi>,  you</p>'
    "<list><item>one</item><item>two</item></list><table><row><cell role=\"head\">A</cell><cell>B</cell></row></table>"
    "<graphic/></main></doc>"
)
SIMPLE = (
    '<doc fingerprint="a&amp;b"><main><head>Title</head><p>Hi there, you</p><ul><li>one</li><li>two</li></ul>'
    "<table><tr><th>A</th><td>B</td></tr></table></main></doc>"
)


def run(spark, *docs):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, xml string")
    return xmltext.simplify(df).orderBy("i").collect()


def test_golden(spark):
    row = run(spark, DOC)[0]
    assert row["xml_simplified"] == SIMPLE
    assert row["markdown_main"] == "[1] # Title\n[2] Hi there, you\n[3] - one; two\n[4] TABLE: H: A | B"
    assert row["markdown_comments"] == "" and not row["skipped"]


@pytest.mark.parametrize(
    "body, line",
    [
        ('<hi rend="#b"><p>Big</p></hi>', "# Big"),
        ('<p>in</p><hi rend="#b"><p>Big</p> tail</hi>', "in\n[2] Big"),
        ("<quote>a<p> b </p>c</quote>", "> abc"),
        ("<p>x<code> f(1) </code> y</p>", "xCODE: f(1) y"),
        ("<code>a\n  b</code>", "CODE: a b"),
        ("<list><item> </item><item>k</item></list>", "- k"),
        ("<table><row><cell/></row><row><cell>v</cell><cell>w</cell></row></table>", "TABLE: R: v | w"),
        ("<h3>H &amp; I</h3>", "# H & I"),
        ("<p><strong>s</strong><em>e</em></p>", "se"),
    ],
)
def test_blocks(spark, body, line):
    assert run(spark, f"<doc><main>{body}</main></doc>")[0]["markdown_main"] == f"[1] {line}"


def test_skips(spark):
    rows = run(spark, "<doc><main/></doc>", "<doc><main>", "<doc><comments><p>c</p></comments></doc>", None,
               "<text><main><p>a</p></main></text>", "<doc><main><p>a</p></main><comments><p>c</p><p>d</p></comments></doc>")
    assert [r["skipped"] for r in rows] == [True] * 5 + [False]
    assert rows[5]["markdown_comments"] == "[1] c\n[2] d"
    assert rows[1]["xml_simplified"] is None


def test_deep_nesting_is_skipped_not_fatal(spark):
    deep = "<doc><main><p>" + "<hi>" * 3000 + "x" + "</hi>" * 3000 + "</p></main></doc>"
    assert [r["skipped"] for r in run(spark, deep, DOC)] == [True, False]


def test_what_stands_around_a_document():
    from registrum.operators.xmltext import _shape

    body = "<doc><main><p>hello</p></main></doc>"
    for text in (f"<TEI>\n{body}\n</TEI>", f"<TEI>{body}</TEI>", body, f"\n{body}"):
        assert _shape(text)["main"], text
    assert _shape("<TEI><p>hello</p></TEI>")["main"] is None
    assert _shape("<doc")["xml"] is None


def test_shapes_are_made_a_few_documents_at_a_time(spark):
    """A batch of any size is taken apart in short slices, in order and whole."""
    xml = ["<doc><main><p>a &amp; b</p></main></doc>", None, "<doc", "<doc><main><list><item>x</item></list></main></doc>"] * 250
    cut = list(xmltext._shape_batches(iter([pa.array(xml)])))
    assert max(map(len, cut)) <= 16
    assert [s for c in cut for s in c.to_pylist()] == [xmltext._shape(x) for x in xml]
