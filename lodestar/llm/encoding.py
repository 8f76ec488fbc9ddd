"""Encode every text with a public byte-level tokenizer; very long texts by tree concatenation.

A text longer than `piece_chars` is cut into pieces, and each piece is encoded by itself, in parallel,
together with the seam to its neighbour: the tokens of its last part and of the neighbour's first part
are encoded again, over a window that grows until its first tokens are the left side's and its last
tokens the right side's. As the encoding is determined by which neighbouring tokens may stand side by
side, a seam that agrees on both sides leaves everything beyond it as it was, so the seams of a text are
independent and its ids are put together in one go. Where a window reaches the far end of a piece, the
two pieces become one, and its seams are sought anew: the tree grows only there.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import load

#: Where the vocabulary files lie, unless TOKENIZER_DIR says otherwise; never copied into the package.
DEFAULT_DIR = "/opt/tokenizers"

#: Characters of a piece. Texts up to this length are encoded in one go.
PIECE_CHARS = 8_192

#: Fixed value: the published splitting pattern of byte-level BPE vocabularies of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_dir() -> str:
    return os.environ.get("TOKENIZER_DIR", DEFAULT_DIR)


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tokenizer of a `.tiktoken` file of ranks. Kept per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _ordinary(enc, text: str) -> list[int]:
    """Ids of a text without special tokens; their strings are ordinary text."""
    return enc.encode_ordinary(text)


def _cuts(enc, ids: list[int]) -> list[int]:
    """Byte offset after each token."""
    out, n = [], 0
    for t in ids:
        n += len(enc.decode_single_token_bytes(t))
        out.append(n)
    return out


def _text_start(data: bytes, at: int) -> bool:
    """Whether a character starts at a byte offset."""
    return at >= len(data) or (data[at] & 0xC0) != 0x80


Seam = tuple[int, list[int], int]


def seam(enc, left_text: str, left: list[int], right_text: str, right: list[int], size: int = 64) -> Seam | None:
    """How the ids of two neighbours join: ids kept of the left, ids between, ids left out of the right.

    None where no window smaller than both sides agrees with both.
    """
    a, b = left_text.encode("utf-8", "surrogatepass"), right_text.encode("utf-8", "surrogatepass")
    while True:
        # window: the last tokens of the left and the first tokens of the right, `size` bytes or more of each
        i, n = len(left), 0
        while i > 0 and (n < size or not _text_start(a, len(a) - n)):
            i -= 1
            n += len(enc.decode_single_token_bytes(left[i]))
        j, m = 0, 0
        while j < len(right) and (m < size or not _text_start(b, m)):
            m += len(enc.decode_single_token_bytes(right[j]))
            j += 1
        if i == 0 or j == len(right):
            return None
        ids = _ordinary(enc, (a[len(a) - n :] + b[:m]).decode("utf-8", "surrogatepass"))
        inner = [0, *_cuts(enc, ids)]
        # tokens that both the left side and the window have before the join, and the right one after it
        first, last = _agree_left(enc, left[i:], ids, n), _agree_right(enc, right[:j], ids, m, inner[-1])
        if first is not None and last is not None and first[1] <= last[1]:
            return i + first[0], ids[first[1] : last[1]], last[0]
        size *= 2


def put_together(enc, texts: list[str], ids: list[list[int]], seams: list[Seam | None]) -> list[int]:
    """Ids of the concatenation of the texts; `seams[k]` joins piece k with the next.

    Pieces whose seam is missing, or whose two seams overlap, become one and are encoded again.
    """
    while True:
        used = [0, *(s[2] if s else 0 for s in seams)]
        loose = [k for k, s in enumerate(seams) if s is None or s[0] < used[k]]
        if not loose:
            out: list[int] = []
            for k, own in enumerate(ids):
                s = seams[k] if k < len(seams) else None
                out += own[used[k] : s[0] if s else None]
                out += s[1] if s else []
            return out
        groups = [[0]]
        for k in range(1, len(texts)):
            if k - 1 in set(loose):
                groups[-1].append(k)
            else:
                groups.append([k])
        merged = ["".join(texts[k] for k in g) for g in groups]
        again = [ids[g[0]] if len(g) == 1 else _ordinary(enc, t) for g, t in zip(groups, merged)]
        kept = []
        for g, h, x, y, p, q in zip(groups, groups[1:], merged, merged[1:], again, again[1:]):
            kept.append(seams[g[-1]] if len(g) == len(h) == 1 else seam(enc, x, p, y, q))
        texts, ids, seams = merged, again, kept


def _agree_left(enc, own: list[int], ids: list[int], limit: int) -> tuple[int, int] | None:
    """Places (in `own`, in `ids`) after the last two equal tokens in a row that lie side by side at the same bytes.

    The window's first token may differ, as the pattern may start otherwise there; two tokens equal
    in a row show that both encodings run alike from there on.
    """
    ends_own = {e: k for k, e in enumerate(_cuts(enc, own))}
    best, run = None, 0
    for k, e in enumerate(_cuts(enc, ids)):
        if e > limit:
            break
        o = ends_own.get(e)
        run = run + 1 if o is not None and own[o] == ids[k] and (run == 0 or (o > 0 and own[o - 1] == ids[k - 1])) else 0
        if run >= 2 and best is None:
            best = (o + 1, k + 1)
    return best


def _agree_right(enc, own: list[int], ids: list[int], length: int, total: int) -> tuple[int, int] | None:
    """Places of the first of two equal tokens in a row at the same bytes after the join."""
    start = total - length
    begins, n = {}, start
    for k, t in enumerate(own):
        begins[n] = k
        n += len(enc.decode_single_token_bytes(t))
    n, hits = 0, []
    for k, t in enumerate(ids):
        if n >= start and (o := begins.get(n)) is not None and own[o] == t:
            hits.append((o, k))
        n += len(enc.decode_single_token_bytes(t))
    pairs = set(hits)
    good = [(o, k) for o, k in hits if (o + 1, k + 1) in pairs]
    return good[-1] if good else None


def _pieces(text: str, size: int) -> list[str]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def join_all(enc, parts: list[tuple[str, list[int]]]) -> list[int]:
    """Ids of the concatenation of encoded parts."""
    texts, ids = [t for t, _ in parts], [list(i) for _, i in parts]
    return put_together(enc, texts, ids, [seam(enc, *x, *y) for x, y in zip(parts, parts[1:])]) if parts else []


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(`key`, `ids`) of each row of `df`, without special tokens.

    Null and empty texts give an empty array; repeated rows give repeated rows; a null key stays
    null; no rows give no rows. Other columns are not read. Only texts longer than `piece_chars`
    are shuffled, as pieces.
    """
    path = os.path.join(tokenizer_dir(), vocabulary)
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = [_ordinary(enc, t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["k", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of each text, each with the next, in one walk over the text."""
        for batch in batches:
            for i, (row, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                parts = _pieces(t, piece_chars)
                n = len(parts)
                columns = [batch.column(0).take(pa.array([i] * n)), pa.array([row] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(parts), pa.array([*parts[1:], None], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["k", "row", "piece", "t", "following"])

    def seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids, keep, between, skip = [], [], [], []
            for t, following in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                own = _ordinary(enc, t)
                s = seam(enc, t, own, following, _ordinary(enc, following)) if following is not None else None
                ids.append(own)
                for column, x in zip((keep, between, skip), s or (None, None, None)):
                    column.append(x)
            listed = pa.list_(pa.int32())
            columns = [*batch.columns[:4], pa.array(ids, listed), pa.array(keep, pa.int32()), pa.array(between, listed), pa.array(skip, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["k", "row", "piece", "t", "ids", "keep", "between", "skip"])

    def joined(pdf):
        import pandas as pd

        rows = pdf.sort_values("piece")
        found = [None if k != k or k is None else (int(k), [int(x) for x in m], int(s)) for k, m, s in zip(rows["keep"], rows["between"], rows["skip"])][:-1]
        ids = put_together(encoder(path), list(rows["t"]), [[int(x) for x in i] for i in rows["ids"]], found)
        return pd.DataFrame({"k": rows["k"].iloc[:1], "ids": [ids]})

    short = rows.where((F.length("t") <= piece_chars) | F.col("t").isNull()).mapInArrow(whole, f"k {kind}, ids array<int>")
    # a text is known by its place in the scan, so that repeated rows stay apart
    long = (
        rows.where(F.length("t") > piece_chars)
        .select("k", F.monotonically_increasing_id().alias("row"), "t")
        .mapInArrow(cut, f"k {kind}, row bigint, piece int, t string, following string")
        .repartition("row", "piece")
        .mapInArrow(seams, f"k {kind}, row bigint, piece int, t string, ids array<int>, keep int, between array<int>, skip int")
        .groupBy("row")
        .applyInPandas(joined, f"k {kind}, ids array<int>")
    )
    return short.unionByName(long).select(F.col("k").alias(key), "ids")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(load(spark, sf_dir, "documents"))
