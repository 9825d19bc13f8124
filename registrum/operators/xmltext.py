"""Raw document XML to simplified XML and numbered lines.

Mixed content needs a tree walk, which runs as an Arrow function over one
column. It only reshapes: the rewritten XML, and per block its kind and its raw
text parts. White space, prefixes, joining and numbering are column
expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import escape
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registrum.functions import text as T
from registrum.functions.arrays import bind

# Source tag to simplified tag. Any other tag gives way to its content.
TAGS = {
    "doc": "doc",
    "main": "main",
    "comments": "comments",
    "p": "p",
    "head": "head",
    "h1": "head",
    "h2": "head",
    "h3": "head",
    "h4": "head",
    "h5": "head",
    "h6": "head",
    "item": "li",
    "list": "ul",
    "quote": "blockquote",
    "blockquote": "blockquote",
    "table": "table",
    "row": "tr",
    "cell": "td",
    "td": "td",
    "th": "th",
    "tr": "tr",
    "li": "li",
    "code": "code",
}
# Kept attributes per source tag.
KEPT_ATTRIBUTES = {"doc": ["fingerprint"]}

_ROW = "struct<head:boolean,cells:array<string>>"
_BLOCK = f"struct<kind:string,text:string,items:array<string>,rows:array<{_ROW}>>"
_SHAPE = f"struct<xml:string,main:array<{_BLOCK}>,comments:array<{_BLOCK}>>"

_ARROW_BLOCK = pa.struct(
    [
        ("kind", pa.string()),
        ("text", pa.string()),
        ("items", pa.list_(pa.string())),
        ("rows", pa.list_(pa.struct([("head", pa.bool_()), ("cells", pa.list_(pa.string()))]))),
    ]
)
_ARROW_SHAPE = pa.struct([("xml", pa.string()), ("main", pa.list_(_ARROW_BLOCK)), ("comments", pa.list_(_ARROW_BLOCK))])
# Documents that are taken apart at a time, whatever the size of the batches they come in.
_SHAPED_ROWS = 16

_LINE_BREAKS = {ord(c): " " for c in "\n\r\t"}


def _blank(text: str | None) -> bool:
    return not (text and text.strip())


def _bold(node: ElementTree.Element) -> bool:
    return node.tag == "hi" and "#b" in node.get("rend", "")


def _all_bold(node: ElementTree.Element) -> bool:
    """Nothing but bold spans: such a paragraph is a heading."""
    return _blank(node.text) and len(node) > 0 and all(_bold(c) and _blank(c.tail) for c in node)


def _wraps_paragraph(node: ElementTree.Element) -> bool:
    """A bold span around one paragraph and nothing else is a heading too."""
    return _bold(node) and len(node) == 1 and node[0].tag == "p" and _blank(node.text) and _blank(node[0].tail)


def _target(node: ElementTree.Element) -> str | None:
    if node.tag == "cell" and node.get("role") == "head":
        return "th"
    if node.tag == "p" and _all_bold(node):
        return "head"
    return TAGS.get(node.tag)


def _squeeze(text: str | None) -> str:
    """Escaped text with its white space reduced to single blanks."""
    flat = escape(text or "").translate(_LINE_BREAKS)
    while "  " in flat:
        flat = flat.replace("  ", " ")
    return flat


def _content(node: ElementTree.Element) -> str:
    parts = [_squeeze(node.text)]
    for child in node:
        parts += [_rewrite(child), _squeeze(child.tail)]
    return "".join(parts)


def _rewrite(node: ElementTree.Element) -> str:
    if _wraps_paragraph(node):
        tag, body = "head", _content(node[0])
    else:
        tag, body = _target(node), _content(node)
    if tag is None:
        return body
    body = body.strip()
    if not body:
        return ""
    kept = "".join(f' {a}="{escape(node.get(a))}"' for a in KEPT_ATTRIBUTES.get(node.tag, []) if a in node.attrib)
    return f"<{tag}{kept}>{body}</{tag}>"


def _flat(text: str) -> str:
    return " ".join(text.split())


def _inline(node: ElementTree.Element) -> str:
    """Text of a block; inner code is announced, inner elements are trimmed."""
    parts = [node.text or ""]
    for child in node:
        if child.tag == "code":
            code = _flat("".join(child.itertext()))
            parts.append(f"CODE: {code}" if code else "")
        else:
            parts.append(_inline(child))
        parts.append(child.tail or "")
    return _flat("".join(parts))


def _blocks(section: ElementTree.Element | None) -> list[dict]:
    """Direct children a line is made of, each with the parts its kind needs."""
    out = []
    for node in section if section is not None else []:
        block = {"kind": node.tag, "text": None, "items": None, "rows": None}
        if node.tag in ("head", "p", "blockquote"):
            block["text"] = _inline(node)
        elif node.tag == "code":
            block["text"] = "".join(node.itertext())
        elif node.tag == "ul":
            block["items"] = [_inline(li) for li in node.findall("li")]
        elif node.tag == "table":
            block["rows"] = []
            for tr in node.findall("tr"):
                cells = [c for c in tr if c.tag in ("td", "th")]
                block["rows"].append(
                    {"head": any(c.tag == "th" for c in cells), "cells": [_inline(c) for c in cells]}
                )
        else:
            continue
        out.append(block)
    return out


def _shape(xml: str | None) -> dict:
    """One document; all null when the XML does not parse."""
    out = {"xml": None, "main": None, "comments": None}
    try:
        simplified = _rewrite(ElementTree.fromstring(xml))
        while "  " in simplified:
            simplified = simplified.replace("  ", " ")
        out["xml"] = simplified
    except Exception:
        return out
    # What stood around the document may be left as blanks, or as text, which no longer parses.
    try:
        root = ElementTree.fromstring(simplified)
    except ElementTree.ParseError:
        return out
    if root.tag == "doc":
        out.update({s: _blocks(root.find(s)) for s in ("main", "comments")})
    return out


def _shape_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Shapes of documents; only a few are Python objects at once."""
    for xml in batches:
        for start in range(0, len(xml), _SHAPED_ROWS):
            yield pa.array([_shape(x) for x in xml.slice(start, _SHAPED_ROWS).to_pylist()], _ARROW_SHAPE)
        pa.default_memory_pool().release_unused()


def _line(block: Column) -> Column:
    """One block as one line, empty when it has no text."""
    text = T.collapse_whitespace(block["text"])
    items = F.filter(block["items"], lambda t: t != "")
    rows = F.filter(
        F.transform(
            block["rows"],
            lambda r: bind(
                F.filter(r["cells"], lambda t: t != ""),
                lambda cells: F.when(
                    F.size(cells) > 0,
                    F.concat(F.when(r["head"], "H: ").otherwise("R: "), F.array_join(cells, " | ")),
                ),
            ),
        ),
        lambda r: r.isNotNull(),
    )

    def prefixed(prefix: str, body: Column, there: Column) -> Column:
        return F.when(there, F.concat(F.lit(prefix), body)).otherwise("")

    kind = block["kind"]
    return (
        F.when(kind == "head", prefixed("# ", text, text != ""))
        .when(kind == "blockquote", prefixed("> ", text, text != ""))
        .when(kind == "code", prefixed("CODE: ", text, text != ""))
        .when(kind == "ul", prefixed("- ", F.array_join(items, "; "), F.size(items) > 0))
        .when(kind == "table", prefixed("TABLE: ", F.array_join(rows, " ; "), F.size(rows) > 0))
        .otherwise(text)
    )


def section_markdown(blocks: Column) -> Column:
    """Blocks to numbered lines; a section without lines is the empty string."""
    lines = F.filter(F.transform(blocks, _line), lambda t: t != "")
    return F.coalesce(T.number_lines(lines), F.lit(""))


def simplify(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """Add simplified XML and both sections' lines; keep every row.

    ``skipped`` marks rows without simplified XML or without main text.
    """
    shape = F.arrow_udf(_shape_batches, _SHAPE).asNondeterministic()
    shaped = docs.withColumn("_shape", shape(F.col(xml)))
    out = shaped.select(
        *docs.columns,
        F.col("_shape.xml").alias("xml_simplified"),
        section_markdown(F.col("_shape.main")).alias("markdown_main"),
        section_markdown(F.col("_shape.comments")).alias("markdown_comments"),
    )
    return out.withColumn(
        "skipped", (F.coalesce("xml_simplified", F.lit("")) == "") | (F.col("markdown_main") == "")
    )


def simplified_documents(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """The rows the stage writes: those not skipped."""
    return simplify(docs, xml).where(~F.col("skipped")).drop("skipped")


def written_and_skipped(docs: DataFrame, xml: str = "xml") -> DataFrame:
    return simplify(docs, xml).agg(
        F.count_if(~F.col("skipped")).alias("written"), F.count_if("skipped").alias("skipped")
    )
