"""Items above a size limit cut into pieces at natural boundaries, with overlap.

Separators form a hierarchy: section, paragraph, line, sentence, word, character. A text is cut by
the first; parts still above the limit are cut by the next, and so on. Parts are then packed
greedily, each piece but the first beginning with the end of the one before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import load

OVERLAP = 100
CHUNK_LIMIT, DOCUMENT_LIMIT = 900, 6_000

#: Where a text may be cut, the best place first; a part keeps the separator at its end.
SEPARATORS = (
    ("section", re.compile(r"(?:\r?\n[ \t]*){3,}|\n(?=[A-ZÀ-Þ][A-ZÀ-Þ &]{3,60}\n)")),
    ("paragraph", re.compile(r"(?:\r?\n[ \t]*){2,}|\r{2,}")),
    ("line", re.compile(r"\r\n|\n|\r")),
    ("sentence", re.compile(r"(?<=[.!?;…])[)\]\"'”»’]*\s+")),
    ("word", re.compile(r"\s+")),
)

_SCHEMA = "item_key string, item_hash bigint, piece int, boundary string, char_start int, char_end int, overlap int, piece_text string"


def _parts(text: str, start: int, end: int, limit: int, level: int) -> Iterator[tuple[int, int, str]]:
    """Consecutive spans of at most `limit` characters that cover `start` to `end`, with the kind of their end."""
    if end - start <= limit:
        yield start, end, SEPARATORS[level - 1][0] if level else "end"
        return
    if level == len(SEPARATORS):
        for at in range(start, end, limit):
            yield at, min(at + limit, end), "character"
        return
    name, pattern = SEPARATORS[level]
    last = start
    for m in pattern.finditer(text, start, end):
        if m.end() > last and m.end() < end:
            yield from _inner(text, last, m.end(), limit, level, name)
            last = m.end()
    yield from _inner(text, last, end, limit, level, name)


def _inner(text: str, start: int, end: int, limit: int, level: int, name: str) -> Iterator[tuple[int, int, str]]:
    """A part as it is, or cut by the finer separators; its last span ends where the part does."""
    if end - start <= limit:
        yield start, end, name
        return
    held = None
    for span in _parts(text, start, end, limit, level + 1):
        if held:
            yield held
        held = span
    if held:
        yield held[0], held[1], name


def _tail(text: str, start: int, end: int, overlap: int) -> int:
    """Where the last `overlap` characters before `end` begin, moved on to the start of a word.

    Where no word begins among them the overlap is exactly `overlap` characters.
    """
    at = max(start, end - overlap)
    if at == start or text[at - 1].isspace():
        return at
    m = re.compile(r"\s+(?=\S)").search(text, at, end)
    return m.end() if m else at


def split_text(text: str, limit: int, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(start, end, characters repeated from the piece before, kind of boundary at the end) of each piece.

    A text within the limit is one piece. Every piece is within the limit, the pieces cover the text,
    and cut off their overlaps they are the text. The overlap must be less than half the limit.
    """
    if limit <= 2 * overlap:
        raise ValueError("the overlap must be less than half the limit")
    if len(text) <= limit:
        return [(0, len(text), 0, "end")]
    room = limit - overlap
    pieces: list[tuple[int, int, int, str]] = []
    begin, fresh, last, kind = 0, 0, 0, "end"
    for start, end, name in _parts(text, 0, len(text), room, 0):
        if end - begin > limit and last > fresh:
            pieces.append((begin, last, fresh - begin, kind))
            begin, fresh = _tail(text, begin, last, overlap), last
        last, kind = end, name
    pieces.append((begin, last, fresh - begin, "end"))
    return pieces


def squeezed(text: Column) -> Column:
    """Runs of space, tab, CR and LF as one space, without such at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def split_items(df: DataFrame, key: str, text: Column, limit: int, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of each row whose text is longer than `limit` code points; shorter ones are left alone.

    Columns: `item_key` (the key as a string), `item_hash` (of the text, as keys may repeat), `piece`
    from 0, `boundary` at the piece's end, `char_start`, `char_end`, `overlap`, `piece_text`. Null and
    empty texts and empty tables give no rows; repeated rows give repeated pieces; a null key stays
    null; the longest texts are cut whole. Rows are independent: nothing is shuffled, and only
    oversized texts reach Python. Other columns are not read.
    """
    rows = df.select(F.col(key).cast("string").alias("k"), text.alias("t")).where(F.length("t") > limit).select("k", F.xxhash64("t"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, h, t in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(k, h, i, kind, a, b, over, t[a:b]) for i, (a, b, over, kind) in enumerate(split_text(t, limit, overlap))]
            if out:
                types = [pa.string(), pa.int64(), pa.int32(), pa.string(), *[pa.int32()] * 3, pa.string()]
                names = ["item_key", "item_hash", "piece", "boundary", "char_start", "char_end", "overlap", "piece_text"]
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out), types)], names)

    return rows.mapInArrow(run, _SCHEMA)


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = split_items(load(spark, sf_dir, "chunks"), "chunk_id", squeezed(F.col("text")), CHUNK_LIMIT)
    documents = split_items(load(spark, sf_dir, "documents"), "doc_id", F.col("text"), DOCUMENT_LIMIT)
    return chunks.withColumn("item_table", F.lit("chunks")).unionByName(documents.withColumn("item_table", F.lit("documents")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that had to be cut: those with a second piece."""
    return _pieces(spark, sf_dir).where("piece = 1").select("item_table", "item_key").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece with its place."""
    return _pieces(spark, sf_dir)


P5_FOUND = """
SELECT DISTINCT 'chunks' AS item_table, chunk_id AS item_key FROM chunks
WHERE length(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))) > 900
UNION ALL
SELECT DISTINCT 'documents' AS item_table, CAST(doc_id AS VARCHAR) AS item_key FROM documents WHERE length(text) > 6000
"""
