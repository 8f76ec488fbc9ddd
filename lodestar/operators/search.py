"""Lexical and dense search for batches of queries as rows; fusion and best hits per entity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.dates import let

K1, B = 1.2, 0.75
RRF_K = 60
#: Query vectors sent to the executors at once.
QUERY_BLOCK = 4096
#: Query texts sent to the executors at once, and documents scored against them at once.
TEXT_BLOCK, DOC_BLOCK = 1024, 2000
#: Query vectors scored against an Arrow batch at once.
SCORE_BLOCK = 256


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits; the dotted capital I is an i, not one with a mark that would part the word."""
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("İ"), F.lit("i"))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bm25(docs: DataFrame, doc_id: str, text: Column, queries: list[tuple[str, str]], k: int = 50) -> DataFrame:
    """(`query`, `doc_id`, `score`, `place`): the `k` best of each query by BM25, score rounded to 4, ties by id.

    idf is ln((N - n + 0.5) / (n + 0.5)), 1e-6 at least. Null texts count as empty. Only the queries'
    terms are exploded, frequencies are counted before the shuffle, and N and the mean length are
    two numbers taken in one pass.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("d"), terms(F.coalesce(text, F.lit(""))).alias("w")).select("d", "w", F.size("w").alias("len"))
    n, mean = rows.agg(F.count("*"), F.avg("len")).first()  # two numbers
    asked = [(name, t) for name, q in queries for t in sorted(set(_plain_terms(q)))]
    wanted = spark.createDataFrame(asked, "query string, t string")
    used = sorted({t for _, t in asked})
    hits = rows.select("d", "len", F.explode(F.filter("w", lambda x: x.isin(used))).alias("t")).groupBy("d", "len", "t").agg(F.count("*").alias("tf"))
    df = hits.groupBy("t").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weighed = hits.join(F.broadcast(df.select("t", idf.alias("idf"))), "t")  # a row a query term
    norm = K1 * (1 - B + B * F.col("len") / (mean or 1.0))
    scored = weighed.join(F.broadcast(wanted), "t").select("query", "d", (F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("s"))
    total = scored.groupBy("query", "d").agg(F.round(F.sum("s"), 4).alias("score"))
    return best(total, "d", k).withColumnRenamed("d", doc_id)


def bm25_rows(docs: DataFrame, doc_id: str, text: Column, queries: DataFrame, query: str, query_text: Column, k: int = 50) -> DataFrame:
    """`bm25` where queries are rows too: all different terms of a query text count but those of one character.

    Queries are read in blocks; the postings of a block's terms, with their idf, are broadcast. Each
    Arrow batch gives its `k` best for each query, and the best of these are kept.
    """
    spark, parts = docs.sparkSession, None
    of, to = docs.schema[doc_id].dataType.simpleString(), queries.schema[query].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("d"), terms(F.coalesce(text, F.lit(""))).alias("w")).select("d", "w", F.size("w").alias("len"))
    n, mean = rows.agg(F.count("*"), F.avg("len")).first()  # two numbers
    asked = queries.select(F.col(query).alias("q"), F.array_distinct(F.filter(terms(query_text), lambda x: F.length(x) > 1)).alias("ts"))
    for names, texts in _text_blocks(asked):
        words = sorted({t for ts in texts for t in ts})
        if not words:
            continue
        own_words = F.broadcast(spark.createDataFrame(pa.table({"t": pa.array(words, pa.string())})))
        known = dict(rows.select(F.explode(F.array_distinct("w")).alias("t")).join(own_words, "t").groupBy("t").count().collect())  # a row a term of the block
        number = {t: i for i, t in enumerate(words)}
        pairs = np.array(sorted((number[t], j) for j, ts in enumerate(texts) for t in ts), np.int64)
        df = np.array([known.get(t, 0) for t in words], np.float64)
        idf = np.maximum(1e-6, np.log((n - df + 0.5) / (df + 0.5)))
        starts = np.searchsorted(pairs[:, 0], np.arange(len(words) + 1))
        sent = spark.sparkContext.broadcast((names, words, idf, starts, pairs[:, 1].copy()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, words, idf, starts, lists = sent.value
            vocabulary = pa.array(words, pa.string())
            for whole in batches:
                for at in range(0, whole.num_rows, DOC_BLOCK):
                    batch = whole.slice(at, DOC_BLOCK)
                    own, m = batch.column(0), batch.num_rows
                    sizes = batch.column(2).to_numpy().astype(np.int64)
                    t = pc.fill_null(pc.index_in(batch.column(1).flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                    doc = np.repeat(np.arange(m), sizes)[t >= 0]
                    cell, tf = np.unique(doc * len(words) + t[t >= 0], return_counts=True)
                    doc, t = np.divmod(cell, len(words))
                    weight = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / (mean or 1.0)))
                    score = np.zeros((m, len(names)))
                    edges = np.searchsorted(doc, np.arange(m + 1))
                    for i in range(m):
                        a, b = edges[i], edges[i + 1]
                        count = starts[t[a:b] + 1] - starts[t[a:b]]
                        total = int(count.sum())
                        if total:
                            place = np.arange(total) + np.repeat(starts[t[a:b]] - np.cumsum(count) + count, count)
                            score[i] = np.bincount(lists[place], np.repeat(weight[a:b], count), len(names))
                    rank = np.empty(m, np.int64)
                    rank[pc.array_sort_indices(own, null_placement="at_start").to_numpy()] = np.arange(m)
                    some = score.T > 0
                    rounded = np.floor(score.T * 1e4 + 0.5) / 1e4
                    which, top = _batch_best(np.where(some, rounded, -1.0), rank, k)
                    hit = some[which, top]
                    which, top = which[hit], top[hit]
                    if len(which):
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(which)), own.take(pa.array(top)), pa.array(rounded[which, top])], ["query", "d", "score"])

        part = rows.mapInArrow(run, f"query {to}, d {of}, score double")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = spark.createDataFrame([], f"query {to}, d {of}, score double")
    return best(parts, "d", k).withColumnRenamed("d", doc_id)


def _text_blocks(asked: DataFrame) -> Iterator[tuple[pa.Array, list[list[str]]]]:
    """Queries in blocks: their ids, and the terms of each."""
    ids, block = [], []
    for q, ts in asked.where(F.size("ts") > 0).toLocalIterator():
        ids.append(q)
        block.append(ts)
        if len(block) == TEXT_BLOCK:
            yield pa.array(ids), block
            ids, block = [], []
    if block:
        yield pa.array(ids), block


def _plain_terms(text: str) -> list[str]:
    """Terms of a query; tokens of one character are left out, at most 32 count."""
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return [t for t in out if len(t) > 1][:32]


def best(scored: DataFrame, item: str, k: int) -> DataFrame:
    """The `k` best items of each query: score, then id. The limit is applied before the shuffle as well."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), item)
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def dense(vectors: DataFrame, vec_id: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """(`query`, `vec_id`, `score`, `place`): exact inner products of every query row against all rows.

    `queries` has columns of the same names; its ids may be of another type. They are read in blocks, each broadcast; each Arrow batch of
    vectors gives its own `k` best for each query of the block, by score rounded to 4 and id as in
    the end, and the best of these are kept. NULL vectors take no part.
    """
    spark, parts = vectors.sparkSession, None
    kind = vectors.schema[vec_id].dataType.simpleString()
    to = queries.schema[vec_id].dataType.simpleString()
    asked_type = to_arrow_type(queries.schema[vec_id].dataType)
    rows = vectors.select(F.col(vec_id).alias("i"), F.col(vector).alias("v")).where("v is not null")
    for ids, block in _query_blocks(queries.select(vec_id, vector).where(F.col(vector).isNotNull())):
        sent = spark.sparkContext.broadcast((ids, block))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = batch.column(0)
                rank = np.empty(batch.num_rows, np.int64)
                rank[pc.array_sort_indices(own, null_placement="at_start").to_numpy()] = np.arange(batch.num_rows)
                v = np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1)
                for at in range(0, len(q), SCORE_BLOCK):
                    score = np.round(q[at : at + SCORE_BLOCK] @ v.T, 6)
                    which, top = _batch_best(score, rank, k)
                    yield pa.RecordBatch.from_arrays([pa.array(names[at + which]).cast(asked_type), own.take(pa.array(top)), pa.array(score[which, top])], ["query", "i", "score"])

        part = rows.mapInArrow(run, f"query {to}, i {kind}, score double")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = rows.select(F.lit(None).cast(to).alias("query"), "i", F.lit(0.0).alias("score")).where(F.lit(False))
    return best(parts.withColumn("score", F.round("score", 4)), "i", k).withColumnRenamed("i", vec_id)


def _batch_best(score: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the `k` best of each row of scores: score rounded to 4, then rank.

    Scores have six decimals; they are rounded half away from zero, and NaN comes first, as in Spark.
    """
    r = np.abs(score)
    r *= 1e6
    np.rint(r, out=r)
    r += 50
    r /= 100
    np.floor(r, out=r)
    r *= np.sign(score)
    r[np.isnan(r)] = np.inf
    keep = min(k, r.shape[1])
    least = np.partition(r, r.shape[1] - keep, axis=1)[:, r.shape[1] - keep]
    which, top = np.nonzero(r >= least[:, None])
    order = np.lexsort((rank[top], -r[which, top], which))
    which, top = which[order], top[order]
    first = np.arange(len(which)) - np.searchsorted(which, which) < k
    return which[first], top[first]


def _query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, block = [], []
    for i, v in queries.toLocalIterator():
        ids.append(i)
        block.append(v)
        if len(block) == QUERY_BLOCK:
            yield np.array(ids), np.array(block, np.float64)
            ids, block = [], []
    if block:
        yield np.array(ids), np.array(block, np.float64)


def rrf(rankings: list[DataFrame], item: str, k: int) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (60 + place) over the rankings an item is in."""
    union = None
    for r in rankings:
        part = r.select("query", item, "place")
        union = part if union is None else union.unionByName(part)
    # an exchange of its own: see SEMANTIC_CONF, which sessions built elsewhere may lack
    fused = union.repartition("query", item).groupBy("query", item).agg(F.round(F.sum(1 / (F.lit(RRF_K) + F.col("place"))), 6).alias("score"))
    return best(fused, item, k)


def best_per_entity(hits: DataFrame, item: str, entity: str, shown: int = 3) -> DataFrame:
    """(`query`, `entity`, `score`, `items`): the best item's score, never a sum, and the first items."""
    w = Window.partitionBy("query", entity).orderBy(F.desc("score"), item)
    first = hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= shown)
    items = F.transform(F.array_sort(F.collect_list(F.struct("r", item))), lambda x: x[item])
    return first.groupBy("query", entity).agg(F.max("score").alias("score"), items.alias("items"))


def hashed_grams(df: DataFrame, key: str, text: str, dim: int = 384) -> DataFrame:
    """(`key`, `bucket`, `n`): words and every second group of four characters, hashed by MD5 into `dim` buckets."""
    def grams(low: Column) -> Column:
        words = F.filter(F.split(low, " +"), lambda w: w != "")
        starts = F.when(F.length(low) > 4, F.sequence(F.lit(1), F.length(low) - 4, F.lit(2))).otherwise(F.array().cast("array<int>"))
        return F.concat(words, F.transform(starts, lambda i: F.substring(low, i, F.lit(4))))

    # let: else the folded text would be made anew for every group
    all_grams = let(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9 ]", " "), grams)
    bucket = (F.conv(F.substring(F.md5("g"), 1, 8), 16, 10).cast("bigint") % dim).alias("bucket")
    return df.select(key, F.explode(all_grams).alias("g")).select(key, bucket).groupBy(key, "bucket").agg(F.count("*").alias("n"))


def hashed_vectors(grams: DataFrame, key: str, dim: int = 384) -> DataFrame:
    """(`key`, `v`): the counts of `hashed_grams` as vectors of length 1."""
    kind = grams.schema[key].dataType.simpleString()
    lists = grams.groupBy(F.col(key).alias("i")).agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n"))  # dim entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.zeros((batch.num_rows, dim))
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(1).offsets.to_numpy()))
            v[row, batch.column(1).flatten().to_numpy()] = batch.column(2).flatten().to_numpy()
            v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
            ends = pa.array(np.arange(0, v.size + 1, dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], ["i", "v"])

    return lists.mapInArrow(run, f"i {kind}, v array<double>").withColumnRenamed("i", key)


#: Words whose buckets are kept at once, and characters folded into counts at once.
KNOWN_WORDS, GRAM_CHARS = 1 << 18, 1 << 22
_DIGIT = np.zeros(256, np.int64)
_DIGIT[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = np.arange(1, 37)
_SIGNS = b" abcdefghijklmnopqrstuvwxyz0123456789"


def hashed_text_vectors(df: DataFrame, key: str, text: str, dim: int = 384) -> DataFrame:
    """The rows of `hashed_vectors(hashed_grams(df, key, text))` in one pass: nothing is exploded or shuffled, and each
    different group of four characters is hashed once a task. Texts without any word or group have no row."""
    kind = df.schema[key].dataType.simpleString()
    low = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9 ]", " ")

    def bucket(gram: bytes) -> int:
        return int.from_bytes(hashlib.md5(gram).digest()[:4], "big") % dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, words = np.full(37**4, -1, np.int32), {}
        for whole in batches:
            size = np.cumsum(pc.binary_length(whole.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < whole.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + GRAM_CHARS, "right")))
                batch = whole.slice(at, to - at)
                at = to
                v = np.zeros((batch.num_rows, dim))
                for i, t in enumerate(batch.column(1).to_pylist()):
                    b = t.encode()
                    own = []
                    for w in b.split():
                        n = words.get(w)
                        if n is None:
                            if len(words) >= KNOWN_WORDS:
                                words.clear()
                            n = words[w] = bucket(w)
                        own.append(n)
                    found = np.array(own, np.int64)
                    if len(b) > 4:
                        c = _DIGIT[np.frombuffer(b, np.uint8)]
                        starts = np.arange(0, len(b) - 4, 2)
                        g = ((c[starts] * 37 + c[starts + 1]) * 37 + c[starts + 2]) * 37 + c[starts + 3]
                        new = g[groups[g] < 0]
                        for x in set(new.tolist()):
                            groups[x] = bucket(bytes((_SIGNS[x // 50653], _SIGNS[x // 1369 % 37], _SIGNS[x // 37 % 37], _SIGNS[x % 37])))
                        found = np.concatenate([found, groups[g]])
                    v[i] = np.bincount(found, minlength=dim)
                norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
                some = norm[:, 0] > 0
                v = v[some] / norm[some]
                ends = pa.array(np.arange(0, v.size + 1, dim, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(some)), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], ["i", "v"])

    return df.select(F.col(key).alias("i"), low.alias("t")).mapInArrow(run, f"i {kind}, v array<double>").withColumnRenamed("i", key)
