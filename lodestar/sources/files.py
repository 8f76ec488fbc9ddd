"""Scans of document files: kinds by their first bytes, DOCX bodies, headers and footers, page blocks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

#: Upload limits: bytes of a file and pages of a document.
MAX_BYTES, MAX_PAGES = 8 * 1024 * 1024, 20


def sniff(content: Column) -> Column:
    """pdf, zip, rtf or unknown by the first bytes; the name's ending counts for nothing."""
    head = F.hex(F.substring(content, 1, 5))
    return F.when(F.startswith(head, F.lit("255044462D")), "pdf").when(F.startswith(head, F.lit("504B0304")), "zip").when(F.startswith(head, F.lit("7B5C727466")), "rtf").otherwise("unknown")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(`path`, `length`, `content`, `kind`, `doc_id`, `within_limit`) of the files under a folder.

    doc_id is the first 16 hexadecimal digits of the content's SHA-256. A zip that holds a
    WordprocessingML body is docx, told by the later DOCX scan.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.select(
        "path", "length", "content", sniff(F.col("content")).alias("kind"), F.substring(F.sha2("content", 256), 1, 16).alias("doc_id"), (F.col("length") <= MAX_BYTES).alias("within_limit")
    )


def _paragraph(node) -> str:
    out = []
    for x in node.iter():
        if x.tag == _W + "t":
            out.append(x.text or "")
        elif x.tag in (_W + "tab", _W + "br", _W + "cr"):
            out.append(" ")
    return "".join(out)


def _table(node) -> list[str]:
    rows = []
    for row in node.findall(_W + "tr"):
        cells = []
        for cell in row.findall(_W + "tc"):
            merge = cell.find(f"{_W}tcPr/{_W}vMerge")
            if merge is not None and merge.get(_W + "val") != "restart":
                continue  # goes on with the cell above
            text = " ".join(t for p in cell.findall(_W + "p") if (t := _paragraph(p).strip()))
            if text and (not cells or cells[-1] != text):
                cells.append(text)
        if cells:
            rows.append(" | ".join(cells))
    return rows


def docx_text(content: bytes) -> tuple[str | None, list[str], str | None]:
    """(body in document order, texts of headers and footers, problem)."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            if "word/document.xml" not in names:
                return None, [], "zip without a text body"
            body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
            lines: list[str] = []
            for child in body if body is not None else []:
                if child.tag == _W + "p":
                    lines.append(_paragraph(child))
                elif child.tag == _W + "tbl":
                    lines += _table(child)
            edges: list[str] = []
            for n in sorted(names):
                if n.startswith(("word/header", "word/footer")) and n.endswith(".xml"):
                    text = " ".join(t for p in ElementTree.fromstring(z.read(n)).iter(_W + "p") if (t := _paragraph(p).strip()))
                    if text and text not in edges:
                        edges.append(text)
            return "\n".join(lines), edges, None
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, RuntimeError) as e:
        return None, [], f"unreadable: {type(e).__name__}"


def docx_scan(found: DataFrame) -> DataFrame:
    """(`path`, `doc_id`, `text`, `header_footer`, `problem`) of the zip files of `files`; a bad file is a row, never an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts, edges, problems = zip(*map(docx_text, f["content"])) if len(f) else ((), (), ())
            yield pd.DataFrame({"path": f["path"], "doc_id": f["doc_id"], "text": list(texts), "header_footer": list(edges), "problem": list(problems)})

    rows = found.where("kind = 'zip'").select("path", "doc_id", "content")
    return rows.mapInPandas(run, "path string, doc_id string, text string, header_footer array<string>, problem string")


#: Blocks on each side of a column's edge, the part of the page's height each side runs over, and the
#: part of the shorter side that runs beside the other.
MIN_BLOCKS, MIN_SPAN, MIN_OVERLAP = 3, 0.30, 0.35


def reading_order(blocks: DataFrame, min_gap: float = 70.0, share: float = 0.12, band: float = 6.0) -> DataFrame:
    """Adds `col` and `place` to page blocks (`doc`, `page`, `width`, `height`, `x0`, `y0`, `x1`, `y1`): columns from
    left to right, each from top to bottom.

    A column begins at a left edge that is more than `min_gap` and `share` of the page right of the edge
    before, where both sides look like columns (MIN_BLOCKS, MIN_SPAN, MIN_OVERLAP); a centred name or a
    stray label opens none. All by windows over a page, so no page is compared with itself.
    """
    page = Window.partitionBy("doc", "page")
    by_x = page.orderBy("__x")
    left, right = by_x.rangeBetween(Window.unboundedPreceding, -1), by_x.rangeBetween(0, Window.unboundedFollowing)
    placed = blocks.withColumn("__x", F.round("x0").cast("long"))
    side = lambda w: (F.count("*").over(w), F.min("y0").over(w), F.max("y1").over(w))
    (n, top, end), (m, top_, end_) = side(left), side(right)
    spans = (end - top >= MIN_SPAN * F.col("height")) & (end_ - top_ >= MIN_SPAN * F.col("height"))
    beside = F.least(end, end_) - F.greatest(top, top_) >= MIN_OVERLAP * F.least(end - top, end_ - top_)
    far = F.col("__x") - F.max("__x").over(left) > F.greatest(F.lit(min_gap), F.col("width") * share)
    first = F.col("__nth") == F.min("__nth").over(Window.partitionBy("doc", "page", "__x"))  # of several with one edge
    numbered = placed.withColumn("__nth", F.row_number().over(page.orderBy("__x", "y0")))
    opens = numbered.withColumn("__opens", (first & far & (n >= MIN_BLOCKS) & (m >= MIN_BLOCKS) & spans & beside).cast("int"))
    column = F.sum(F.coalesce("__opens", F.lit(0))).over(by_x.rangeBetween(Window.unboundedPreceding, 0)).cast("int")
    out = opens.withColumn("col", column).drop("__x", "__nth", "__opens")
    order = Window.partitionBy("doc", "page").orderBy("col", F.floor(F.col("y0") / band), "x0")
    return out.withColumn("place", F.row_number().over(order))


def hidden_spans(spans: DataFrame) -> DataFrame:
    """Spans (`page`, `text`, `r`, `g`, `b`, `size`) nobody can see: nearly white, or under 3 points, of 12 characters or more."""
    white = (F.col("r") > 245) & (F.col("g") > 245) & (F.col("b") > 245)
    return spans.where((F.length(F.trim("text")) >= 12) & (white | (F.col("size") < 3))).withColumn("why", F.when(white, "white").otherwise("tiny"))
