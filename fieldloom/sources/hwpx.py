"""HWPX documents (zip files of XML) as tables of cells."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts

CELL = "row int, col int, row_span int, col_span int, width int, height int, raw string, bold string"
SCHEMA = f"path string, error string, raw string, tables array<array<struct<{CELL.replace(' ', ':').replace(',:', ',')}>>>"


def _of(node: ElementTree.Element, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a name in any namespace, in order of the document."""
    return (e for e in node.iter() if e.tag == tag or e.tag.endswith("}" + tag))


def _text(node: ElementTree.Element) -> str:
    return "".join("".join(t.itertext()) for t in _of(node, "t"))


def _cell(tc: ElementTree.Element, bold: set[str]) -> dict:
    own = {e.tag.rsplit("}", 1)[-1]: e for e in tc}
    number = lambda part, name, least: max(least, int(own[part].get(name, least))) if part in own else least
    runs = [[r for r in _of(p, "run") if _text(r)] for p in _of(tc, "p")]
    return {
        "row": number("cellAddr", "rowAddr", 0), "col": number("cellAddr", "colAddr", 0),
        "row_span": number("cellSpan", "rowSpan", 1), "col_span": number("cellSpan", "colSpan", 1),
        "width": number("cellSz", "width", 0), "height": number("cellSz", "height", 0),
        "raw": "\n".join("".join(map(_text, line)) for line in runs if line),
        "bold": "".join(_text(r) for line in runs for r in line if r.get("charPrIDRef") in bold),
    }


def _document(content: bytes) -> tuple[str | None, str, list]:
    """(error, text, tables) of one file."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = sorted(n for n in z.namelist() if n.startswith("Contents/section") and n.endswith(".xml"))
            if not names:
                return "no section", "", []
            bold = set()
            if "Contents/header.xml" in z.namelist():
                try:
                    styles = _of(ElementTree.fromstring(z.read("Contents/header.xml")), "charPr")
                    bold = {c.get("id") for c in styles if any(e.tag.rsplit("}", 1)[-1] == "bold" for e in c)} - {None}
                except ElementTree.ParseError:
                    pass  # a damaged header only loses what is bold
            sections = [ElementTree.fromstring(z.read(n)) for n in names]
    except (zipfile.BadZipFile, ElementTree.ParseError, EOFError, OSError) as e:
        return f"damaged: {e}", "", []
    tables = [[_cell(tc, bold) for tc in _of(tbl, "tc")] for s in sections for tbl in _of(s, "tbl")]
    return None, "\n".join("".join(t.itertext()) for s in sections for t in _of(s, "t")), [t for t in tables if t]


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [(path, *_document(content)) for path, content in zip(b["path"], b["content"])]
        yield pd.DataFrame(found, columns=["path", "error", "raw", "tables"])


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, ok, error, text, tables) per file; a damaged one has its error and no table."""
    d = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_parsed, SCHEMA)
    return d.select("path", F.col("error").isNull().alias("ok"), "error", texts.normalized(F.col("raw")).alias("text"), "tables")


def cells(docs: DataFrame) -> DataFrame:
    """(path, tbl, cell, row, col, row_span, col_span, width, height, raw, text, bold_text) of documents; tbl and cell count from 0."""
    t = docs.select("path", F.posexplode("tables").alias("tbl", "t")).select("path", "tbl", F.posexplode("t").alias("cell", "c"))
    return t.select("path", "tbl", "cell", "c.row", "c.col", "c.row_span", "c.col_span", "c.width", "c.height", "c.raw", texts.normalized(F.col("c.raw")).alias("text"), texts.normalized(F.col("c.bold")).alias("bold_text"))
