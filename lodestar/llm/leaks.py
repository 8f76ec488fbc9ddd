"""Evaluation texts that leaked into training text: suffix arrays over shards of the corpus.

A shard is one Arrow batch of documents. Its words become ids of the evaluation texts'
vocabulary; a word that no evaluation text has can't be part of a match, so only stretches of
`min_words` known words or more are kept. The shard's suffixes are sorted, and every suffix of
the evaluation texts is looked up by binary search; each match is then extended word by word to
its longest. Evaluation texts are sent in blocks of bounded size, one pass over the corpus a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import load

#: Consecutive words that make a leak.
MIN_WORDS = 12

#: Characters of evaluation text sent to the executors at once.
BLOCK_CHARS = 16_000_000

#: Words are runs of letters or digits, case ignored.
WORD = re.compile(r"[^\W_]+")

_MATCH_SCHEMA = "doc_key string, item_key string, words int, item_word int, doc_char int"


def words_of(text: str) -> list[str]:
    """Words in the form that ignores case in full: capitals of ß are ss, so it must be so too."""
    return WORD.findall(text.casefold())


#: Pairs of a suffix and an occurrence extended at once.
PAIRS = 1 << 20


class TestBlock:
    """Vocabulary and suffixes of a block of evaluation texts."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], min_words: int) -> None:
        self.min_words = min_words
        self.vocabulary: dict[str, int] = {}
        keys, runs, starts = [], [], []
        for key, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if len(ids) >= min_words:
                starts.append(sum(map(len, runs)))
                keys.append(key)
                runs.append(np.array([*ids, 0], np.int32))  # 0 ends an item and matches nothing
        self.keys = keys
        self.ids = np.concatenate(runs) if runs else np.zeros(0, np.int32)
        self.item = np.repeat(np.arange(len(runs)), [len(r) for r in runs]) if runs else np.zeros(0, int)
        self.item_start = np.array(starts, int)
        self.at = _whole(self.ids, min_words)
        self.prefix = _rows(self.ids, self.at, min_words)


def _whole(ids: np.ndarray, n: int) -> np.ndarray:
    """Positions from which `n` words in a row are known."""
    if len(ids) < n:
        return np.zeros(0, np.int64)
    unknown = np.concatenate([[0], np.cumsum(ids <= 0)])
    return np.flatnonzero(unknown[n:] == unknown[:-n])


def _rows(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The `n` words from each position as one sortable value each."""
    if not len(at):
        return np.zeros(0, f"S{4 * n}")
    table = ids.astype(">u4")[at[:, None] + np.arange(n)]
    return np.ascontiguousarray(table).view(f"S{4 * n}").ravel()


def suffix_array(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """`at` in the order of the suffixes that begin there, compared over the whole of each known stretch.

    Prefix doubling over the stretches that hold `n` words or more: ranks by one word, by two, by
    four and so on, until they are all different or the longest stretch is compared whole. The end of
    a stretch ranks before every word and ends the comparison.
    """
    if not len(at):
        return at
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + n, -1)
    inside = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    # each stretch with one terminator after it
    breaks = np.flatnonzero(np.diff(inside) > 1) + 1
    rank = np.append(np.insert(ids[inside], breaks, 0), 0).astype(np.int64)
    where = np.append(np.insert(inside, breaks, -1), -1)
    ends = rank == 0
    step = 1
    while step < len(rank):
        second = np.zeros(len(rank), np.int64)
        second[:-step] = rank[step:]
        second[ends] = 0
        values, new = np.unique(rank * (rank.max() + 1) + second, return_inverse=True)
        new = new + 1
        new[ends] = 0
        if new.max() == rank.max() and step > 1:
            break
        rank, step = new, step * 2
        if len(values) == len(rank):
            break
    order = where[np.argsort(rank, kind="stable")]
    wanted = np.zeros(len(ids) + 1, bool)
    wanted[at] = True
    return order[(order >= 0) & wanted[order]]


def shard_matches(block: TestBlock, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, item, words, first word of the item, first character of the document) of the longest
    verbatim matches of each suffix of the block that is not the tail of a longer match."""
    n, get = block.min_words, block.vocabulary.get
    docs, parts = [], []
    for d, text in enumerate(texts):
        ids = [get(w, 0) for w in words_of(text)] if text else []
        if len(ids) >= n:
            docs.append(d)
            parts.append(np.array([*ids, 0], np.int32))
    if not parts or not len(block.at):
        return
    ids = np.concatenate(parts)
    owner = np.repeat(docs, [len(p) for p in parts])
    begin = np.repeat(np.cumsum([0, *map(len, parts[:-1])]), [len(p) for p in parts])
    suffixes = suffix_array(ids, _whole(ids, n), n)
    if not len(suffixes):
        return
    keys = _rows(ids, suffixes, n)
    low, high = np.searchsorted(keys, block.prefix, "left"), np.searchsorted(keys, block.prefix, "right")
    hits = np.flatnonzero(high > low)
    sums = np.cumsum(high[hits] - low[hits])
    spans: dict[int, list[int]] = {}
    start = 0
    while start < len(hits):
        # suffixes with about PAIRS occurrences together
        stop = max(start + 1, int(np.searchsorted(sums, (sums[start - 1] if start else 0) + PAIRS, "right")))
        own = hits[start:stop]
        start = stop
        count = high[own] - low[own]
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        t, c = np.repeat(block.at[own], count), suffixes[np.repeat(low[own], count) + within]
        # the tail of a match that began one word earlier is none of its own
        tail = (t > 0) & (c > 0) & (ids[c - 1] > 0) & (block.ids[t - 1] == ids[c - 1])
        t, c = t[~tail], c[~tail]
        size = np.full(len(t), n)
        on = np.arange(len(t))
        while len(on):  # all matches grow by a word together
            following = ids[c[on] + size[on]]
            on = on[(following > 0) & (following == block.ids[t[on] + size[on]])]
            size[on] += 1
        for d, item, words, first, place in zip(owner[c].tolist(), block.item[t].tolist(), size.tolist(), t.tolist(), (c - begin[c]).tolist()):
            if d not in spans:
                spans[d] = [m.start() for m in WORD.finditer(texts[d].casefold())]
            yield d, item, words, first - int(block.item_start[item]), spans[d][place]


def leaked_passages(corpus: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, item_text: str, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Longest verbatim matches of `min_words` words or more between evaluation items and documents.

    Columns `doc_key`, `item_key` (as given), `words`, `item_word`, `doc_char`. Null and empty texts,
    and items of fewer words, match nothing; repeated rows give repeated matches; a null key stays
    null; empty tables give no rows. The corpus is only scanned, never shuffled; texts of any length
    are searched whole. Other columns are not read.
    """
    doc_type, item_type = corpus.schema[doc_key].dataType, items.schema[item_key].dataType
    rows = corpus.select(F.col(doc_key).cast("string"), F.col(text)).where(F.length(text) > 0)
    spark, found = corpus.sparkSession, None
    for block in _blocks(items.select(F.col(item_key).cast("string"), item_text), min_words, block_chars):
        sent = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                keys = batch.column(0)
                out = list(shard_matches(own, batch.column(1).to_pylist()))
                if out:
                    d, i, *rest = zip(*out)
                    columns = [keys.take(pa.array(d)), pa.array([own.keys[x] for x in i], pa.string()), *(pa.array(c, pa.int32()) for c in rest)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_key", "item_key", "words", "item_word", "doc_char"])

        part = rows.mapInArrow(search, _MATCH_SCHEMA)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], _MATCH_SCHEMA)
    return found.select(F.col("doc_key").cast(doc_type).alias(doc_key), F.col("item_key").cast(item_type).alias(item_key), "words", "item_word", "doc_char")


def _blocks(items: DataFrame, min_words: int, block_chars: int) -> Iterator[TestBlock]:
    """Evaluation texts in blocks of at most `block_chars` characters (a longer item is a block of its own).

    Read through a local iterator, so the driver holds one block and one partition at a time.
    """
    block, size = [], 0
    for key, text in items.toLocalIterator():
        if text is None:
            continue
        if block and size + len(text) > block_chars:
            yield TestBlock(block, min_words)
            block, size = [], 0
        block.append((key, text))
        size += len(text)
    if block:
        yield TestBlock(block, min_words)


def without_leaks(corpus: DataFrame, doc_key: str, passages: DataFrame) -> DataFrame:
    """`corpus` without the documents that hold a leaked passage."""
    return corpus.join(passages.select(doc_key).distinct(), doc_key, "left_anti")


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(load(spark, sf_dir, "documents"), "doc_id", "text", load(spark, sf_dir, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every longest match with its place."""
    return _passages(spark, sf_dir)


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that remain once the affected ones are removed."""
    docs = load(spark, sf_dir, "documents")
    return without_leaks(docs, "doc_id", _passages(spark, sf_dir)).select("doc_id", "source", "n_chars")
