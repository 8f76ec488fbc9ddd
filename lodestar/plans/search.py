"""Queries of search, fusion, vocabulary matching, evidence and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import index as IX
from ..operators import profiles as P
from ..operators import search as S
from ..operators import spans
from ..session import materialise, shared_dir
from ..tables import load
from .registry import Registry
from .views import ALL, PARSED, PROFILES, ROLES

registry = Registry()

#: The batch of queries of the samples.
QUERIES = [
    ("q1", "credit index risk for regional banks"), ("q2", "semiconductors earnings model"), ("q3", "Prüfung von Zielen aus Schifffahrt"),
    ("q4", "notes hebdomadaires sur la chimie"), ("q5", "Python pandas factor models"), ("q6", "carbon auction utilities"),
]
_ASKED = ", ".join(f"('{n}', '{t}')" for n, q in QUERIES for t in sorted(set(S._plain_terms(q))))


def _chunks(spark, sf):
    """Each chunk once: a repeated id keeps its greatest text."""
    c = load(spark, sf, "chunks")
    return c.groupBy("chunk_id").agg(F.max_by(F.struct("candidate_id", "text"), F.coalesce("text", F.lit(""))).alias("r")).select("chunk_id", "r.*")


_CHUNKS = """c AS (SELECT * EXCLUDE (rn) FROM (SELECT chunk_id, candidate_id, text, row_number() OVER (PARTITION BY chunk_id ORDER BY coalesce(text, '') DESC) AS rn FROM chunks) WHERE rn = 1)"""


def _bm25(docs: str, k: int) -> str:
    return f"""tok AS (SELECT d, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS w FROM ({docs})), l AS (SELECT d, w, len(w) AS len FROM tok), sizes AS (SELECT count(*) AS n, avg(len) AS mean FROM l),
    asked(query, t) AS (VALUES {_ASKED}), tf AS (SELECT d, len, t, count(*) AS tf FROM (SELECT d, len, unnest(w) AS t FROM l) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
    df AS (SELECT t, greatest(1e-6, ln(((SELECT n FROM sizes) - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM tf GROUP BY 1),
    sc AS (SELECT query, d, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT mean FROM sizes)))), 4) AS score FROM tf JOIN df USING (t) JOIN asked USING (t) GROUP BY ALL),
    lexical AS (SELECT query, d, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, d) AS INT) AS place FROM sc QUALIFY place <= {k})"""


_CHUNK_BM25 = f"WITH {_CHUNKS}, " + _bm25("SELECT chunk_id AS d, coalesce(text, '') AS t FROM c", 50)


@registry.query("SELECT count(*) AS chunks, sum(len) AS terms, round(avg(len), 4) AS mean_length, max(len) AS longest FROM (SELECT len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS len FROM chunks)")
def postings_stats(spark, sf):
    n = load(spark, sf, "chunks").select(F.size(S.terms(F.coalesce("text", F.lit("")))).alias("len"))
    return n.agg(F.count("*").alias("chunks"), F.sum("len").alias("terms"), F.round(F.avg("len"), 4).alias("mean_length"), F.max("len").alias("longest"))


@registry.query(_CHUNK_BM25 + " SELECT query, d AS chunk_id, score, place FROM lexical")
def bm25_topk(spark, sf):
    return S.bm25(_chunks(spark, sf), "chunk_id", F.col("text"), QUERIES, 50)


def _index(spark, sf):
    """Path and manifest of the index of the chunks: opened where it fits them, else built."""
    c = _chunks(spark, sf)
    path = f"{shared_dir(spark).rstrip('/')}/index-chunks-{sf.strip('/').replace('/', '-')}"
    try:
        return path, IX.opened(spark, path, c, "chunk_id", "text")
    except IX.StaleIndex:
        return path, IX.build(c, "chunk_id", "text", path)


@registry.query(_CHUNK_BM25 + " SELECT query, d AS chunk_id, score, place FROM lexical")
def index_bm25(spark, sf):
    """The same hits from the kept index, whose manifest is checked against the chunks."""
    path, manifest = _index(spark, sf)
    return IX.search(spark, path, manifest, "chunk_id", QUERIES, 50)


@registry.query(
    _CHUNK_BM25 + """, h AS (SELECT l.query, c.candidate_id, l.d, l.score, row_number() OVER (PARTITION BY query, candidate_id ORDER BY l.score DESC, d) AS r FROM lexical l JOIN c ON c.chunk_id = l.d)
    SELECT query, candidate_id, max(score) AS score, list(d ORDER BY r) AS items FROM h WHERE r <= 3 GROUP BY 1, 2"""
)
def best_chunk(spark, sf):
    c = _chunks(spark, sf)
    hits = S.bm25(c, "chunk_id", F.col("text"), QUERIES, 50)
    return S.best_per_entity(hits.join(c.select("chunk_id", "candidate_id"), "chunk_id"), "chunk_id", "candidate_id")


def _vectors(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    return v, v.where("vec_id % 100 = 0")


_DENSE = """dn AS (SELECT q.vec_id AS query, e.vec_id, round(round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6), 4) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0)"""


@registry.query(f"WITH {_DENSE} SELECT query, vec_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INT) AS place FROM dn QUALIFY place <= 10")
def dense_topk(spark, sf):
    """The ten nearest of every row whose id is divisible by 100, exactly, against all rows."""
    v, q = _vectors(spark, sf)
    return S.dense(v, "vec_id", "embedding", q, 10)


@registry.query(
    f"""WITH {_DENSE}, k AS (SELECT query, vec_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS p FROM dn QUALIFY p <= 30)
    SELECT query, vec_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INT) AS place FROM k WHERE query <> vec_id QUALIFY place <= 5"""
)
def similar_items(spark, sf):
    """Five most similar others; the item itself is left out after six times as many are taken."""
    v, q = _vectors(spark, sf)
    return S.best(S.dense(v, "vec_id", "embedding", q, 30).where("query <> vec_id").drop("place"), "vec_id", 5)


_DOC_BM25 = _bm25("SELECT doc_id AS d, coalesce(text, '') AS t FROM documents", 50)
_QVEC = [(name, 100 * i) for i, (name, _) in enumerate(QUERIES[:4])]


@registry.query(
    f"""WITH {_DOC_BM25}, qv(query, v) AS (VALUES {', '.join(f"('{a}', {b})" for a, b in _QVEC)}),
    ds AS (SELECT qv.query, e.vec_id AS d, round(round(list_inner_product(x.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6), 4) AS score FROM qv JOIN embeddings x ON x.vec_id = qv.v JOIN embeddings e ON true),
    dense AS (SELECT query, d, row_number() OVER (PARTITION BY query ORDER BY score DESC, d) AS place FROM ds QUALIFY place <= 50),
    f AS (SELECT query, d, round(sum(1 / (60 + place)), 6) AS score FROM (SELECT query, d, place FROM lexical UNION ALL SELECT query, d, place FROM dense) GROUP BY 1, 2)
    SELECT query, d AS doc_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, d) AS INT) AS place FROM f QUALIFY place <= 25"""
)
def rrf_hybrid(spark, sf):
    """BM25 over documents fused with dense search over embeddings; an id stands for both by convention."""
    lexical = S.bm25(load(spark, sf, "documents"), "doc_id", F.col("text"), QUERIES, 50)
    v, _ = _vectors(spark, sf)
    asked = v.where(F.col("vec_id").isin([b for _, b in _QVEC]))
    names = F.create_map(*[F.lit(x) for a, b in _QVEC for x in (b, a)])
    dense = S.dense(v, "vec_id", "embedding", asked, 50).select(F.try_element_at(names, F.col("query").cast("int")).alias("query"), F.col("vec_id").alias("doc_id"), "place")
    return S.rrf([lexical, dense], "doc_id", 25)


_HASH_TEXT = "regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 ]', ' ', 'g')"
_HASH_QUERIES = ", ".join(f"('{n}', '{t}')" for n, t in QUERIES)


def _grams(source: str) -> str:
    return f"""SELECT k, CAST(('0x' || substr(md5(g), 1, 8)) AS BIGINT) % 384 AS bucket, count(*) AS n FROM (
        SELECT k, unnest(list_concat(list_filter(string_split_regex(low, ' +'), lambda w: w <> ''), list_transform(range(1, greatest(1, length(low) - 3), 2), lambda i: substr(low, i, 4)))) AS g FROM ({source})) GROUP BY ALL"""


@registry.query(
    f"""WITH {_CHUNKS}, q(k, text) AS (VALUES {_HASH_QUERIES}), gq AS ({_grams(f"SELECT k, {_HASH_TEXT} AS low FROM q")}), gc AS ({_grams(f"SELECT chunk_id AS k, {_HASH_TEXT} AS low FROM c")}),
    nq AS (SELECT k, sqrt(sum(n * n)) AS size FROM gq GROUP BY 1), nc AS (SELECT k, sqrt(sum(n * n)) AS size FROM gc GROUP BY 1),
    s AS (SELECT gq.k AS query, gc.k AS chunk_id, sum(gq.n * gc.n) AS dot FROM gq JOIN gc USING (bucket) GROUP BY 1, 2),
    r AS (SELECT query, chunk_id, round(dot / (nq.size * nc.size), 4) AS score FROM s JOIN nq ON nq.k = query JOIN nc ON nc.k = chunk_id)
    SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS INT) AS place FROM r QUALIFY place <= 10"""
)
def hash_embedding_topk(spark, sf):
    """Cosine of hashed words and character groups; the few queries' buckets are what is broadcast."""
    gc = S.hashed_grams(_chunks(spark, sf), "chunk_id", "text")
    gq = S.hashed_grams(spark.createDataFrame(QUERIES, "query string, text string"), "query", "text")
    sized = gq.join(gq.groupBy("query").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("qs")), "query").select("query", "bucket", F.col("n").alias("qn"), "qs")
    norms = gc.groupBy("chunk_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("cs"))
    dot = gc.join(F.broadcast(sized), "bucket").groupBy("query", "chunk_id", "qs").agg(F.sum(F.col("qn") * F.col("n")).alias("dot"))
    scored = dot.join(norms, "chunk_id").select("query", "chunk_id", F.round(F.col("dot") / (F.col("qs") * F.col("cs")), 4).alias("score"))
    return S.best(scored, "chunk_id", 10)


# ------------------------------------------------------------------ every hundredth document as a query

_EACH = "SELECT doc_id AS query, coalesce(text, '') AS text FROM documents WHERE doc_id % 100 = 0"


def _bm25_rows(docs: str, k: int) -> str:
    return f"""tok AS (SELECT d, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS w FROM ({docs})), l AS (SELECT d, w, len(w) AS len FROM tok), sizes AS (SELECT count(*) AS n, avg(len) AS mean FROM l),
    each AS (SELECT query, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS t FROM ({_EACH})), asked AS (SELECT * FROM each WHERE length(t) > 1),
    tf AS (SELECT d, len, t, count(*) AS tf FROM (SELECT d, len, unnest(w) AS t FROM l) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
    df AS (SELECT t, greatest(1e-6, ln(((SELECT n FROM sizes) - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM tf GROUP BY 1),
    sc AS (SELECT query, d, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT mean FROM sizes)))), 4) AS score FROM tf JOIN df USING (t) JOIN asked USING (t) GROUP BY ALL),
    lexical AS (SELECT query, d, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, d) AS INT) AS place FROM sc QUALIFY place <= {k})"""


_CHUNK_BM25_ROWS = f"WITH {_CHUNKS}, " + _bm25_rows("SELECT chunk_id AS d, coalesce(text, '') AS t FROM c", 50)


def _asked_rows(spark, sf):
    return load(spark, sf, "documents").where("doc_id % 100 = 0").select("doc_id", "text")


def _chunk_hits(c, spark, sf):
    return S.bm25_rows(c, "chunk_id", F.col("text"), _asked_rows(spark, sf), "doc_id", F.coalesce("text", F.lit("")), 50)


@registry.query(_CHUNK_BM25_ROWS + " SELECT query, d AS chunk_id, score, place FROM lexical")
def bm25_topk_rows(spark, sf):
    """The chunks nearest to the text of every document whose id is divisible by 100."""
    return _chunk_hits(_chunks(spark, sf), spark, sf)


@registry.query(
    _CHUNK_BM25_ROWS + """, h AS (SELECT l.query, c.candidate_id, l.d, l.score, row_number() OVER (PARTITION BY query, candidate_id ORDER BY l.score DESC, d) AS r FROM lexical l JOIN c ON c.chunk_id = l.d)
    SELECT query, candidate_id, max(score) AS score, list(d ORDER BY r) AS items FROM h WHERE r <= 3 GROUP BY 1, 2"""
)
def best_chunk_rows(spark, sf):
    c = _chunks(spark, sf)
    return S.best_per_entity(_chunk_hits(c, spark, sf).join(c.select("chunk_id", "candidate_id"), "chunk_id"), "chunk_id", "candidate_id")


@registry.query(
    f"""WITH {_bm25_rows("SELECT doc_id AS d, coalesce(text, '') AS t FROM documents", 50)}, {_DENSE},
    dense AS (SELECT query, vec_id AS d, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS place FROM dn QUALIFY place <= 50),
    f AS (SELECT query, d, round(sum(1 / (60 + place)), 6) AS score FROM (SELECT query, d, place FROM lexical UNION ALL SELECT query, d, place FROM dense) GROUP BY 1, 2)
    SELECT query, d AS doc_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, d) AS INT) AS place FROM f QUALIFY place <= 25"""
)
def rrf_hybrid_rows(spark, sf):
    """Both sides asked by every row whose id is divisible by 100: its text and its vector."""
    docs = load(spark, sf, "documents")
    lexical = S.bm25_rows(docs, "doc_id", F.col("text"), _asked_rows(spark, sf), "doc_id", F.coalesce("text", F.lit("")), 50)
    v, q = _vectors(spark, sf)
    dense = S.dense(v, "vec_id", "embedding", q, 50).select("query", F.col("vec_id").alias("doc_id"), "place")
    return S.rrf([lexical, dense], "doc_id", 25)


@registry.query(
    f"""WITH {_bm25_rows("SELECT doc_id AS d, coalesce(text, '') AS t FROM documents", 50)}, {_DENSE},
    dense AS (SELECT query, vec_id AS d, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS place FROM dn QUALIFY place <= 50),
    f AS (SELECT query, d, lexical.place AS lexical_place, dense.place AS dense_place, round(coalesce(1 / (60 + lexical.place), 0) + coalesce(1 / (60 + dense.place), 0), 6) AS score FROM lexical FULL JOIN dense USING (query, d)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, d) AS place FROM f QUALIFY place <= 25)
    SELECT query, d AS doc_id, CASE WHEN lexical_place IS NULL THEN 'dense' WHEN dense_place IS NULL THEN 'lexical' ELSE 'hybrid' END AS mode, score, CAST(place AS INT) AS place,
        concat_ws('; ', 'lexical ' || lexical_place, 'dense ' || dense_place) AS explanation FROM r"""
)
def retrieve_explained(spark, sf):
    """Hybrid hits with what each side gave: its place there, and which of the modes alone would have found it."""
    docs = load(spark, sf, "documents")
    lexical = S.bm25_rows(docs, "doc_id", F.col("text"), _asked_rows(spark, sf), "doc_id", F.coalesce("text", F.lit("")), 50).select("query", "doc_id", F.col("place").alias("lexical_place"))
    v, q = _vectors(spark, sf)
    dense = S.dense(v, "vec_id", "embedding", q, 50).select("query", F.col("vec_id").alias("doc_id"), F.col("place").alias("dense_place"))
    part = lambda c: F.coalesce(1 / (F.lit(60) + F.col(c)), F.lit(0.0))
    f = lexical.join(dense, ["query", "doc_id"], "full").withColumn("score", F.round(part("lexical_place") + part("dense_place"), 6))
    sides = ["query", "doc_id", "lexical_place", "dense_place"]
    r = S.best(f.select("query", "doc_id", "score"), "doc_id", 25).join(f.select(*sides), ["query", "doc_id"])
    mode = F.when(F.col("lexical_place").isNull(), "dense").when(F.col("dense_place").isNull(), "lexical").otherwise("hybrid")
    said = F.concat_ws("; ", F.concat(F.lit("lexical "), F.col("lexical_place").cast("string")), F.concat(F.lit("dense "), F.col("dense_place").cast("string")))
    return r.select("query", "doc_id", mode.alias("mode"), "score", "place", said.alias("explanation"))


@registry.query(
    f"""WITH {_CHUNKS}, q AS ({_EACH}), gq AS ({_grams(f"SELECT query AS k, {_HASH_TEXT} AS low FROM q")}), gc AS ({_grams(f"SELECT chunk_id AS k, {_HASH_TEXT} AS low FROM c")}),
    nq AS (SELECT k, sqrt(sum(n * n)) AS size FROM gq GROUP BY 1), nc AS (SELECT k, sqrt(sum(n * n)) AS size FROM gc GROUP BY 1),
    s AS (SELECT gq.k AS query, gc.k AS chunk_id, sum(gq.n * gc.n) AS dot FROM gq JOIN gc USING (bucket) GROUP BY 1, 2),
    r AS (SELECT query, chunk_id, CAST(round(CAST(round(dot / (nq.size * nc.size), 6) AS DECIMAL(9, 6)), 4) AS DOUBLE) AS score FROM s JOIN nq ON nq.k = query JOIN nc ON nc.k = chunk_id)
    SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS INT) AS place FROM r QUALIFY place <= 10"""
)
def hash_embedding_topk_rows(spark, sf):
    """Cosine of hashed words and character groups, asked by every document whose id is divisible by 100."""
    gc = S.hashed_vectors(S.hashed_grams(_chunks(spark, sf), "chunk_id", "text"), "chunk_id")
    gq = S.hashed_vectors(S.hashed_grams(_asked_rows(spark, sf), "doc_id", "text"), "doc_id").withColumnRenamed("doc_id", "chunk_id")
    return S.dense(gc, "chunk_id", "v", gq, 10).where("score > 0")


# ------------------------------------------------------------------ vocabulary and votes

_VOCAB = ["python", "pandas", "sql", "scala", "monte carlo", "time series", "factor models", "options pricing", "credit memo", "earnings model", "supplier map", "risk pack", "margin bridge"]
_GRAM3 = "list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))"


@registry.query(
    f"""WITH {_CHUNKS}, v(label) AS (VALUES {', '.join(f"('{x}')" for x in _VOCAB)}), t AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM c WHERE text IS NOT NULL),
    g AS (SELECT chunk_id, unnest({_GRAM3}) AS label FROM t) SELECT chunk_id, label, count(*) AS hits FROM g JOIN v USING (label) GROUP BY ALL"""
)
def vocab_hits(spark, sf):
    """Whole-word hits of a vocabulary: groups of up to three words joined with it, so its size doesn't matter."""
    w = F.col("w")
    two = lambda n: F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
    grams = F.concat(w, *[F.transform(two(n), _joined(w, n)) for n in (2, 3)])
    t = _chunks(spark, sf).where("text is not null").select("chunk_id", S.terms(F.col("text")).alias("w")).select("chunk_id", F.explode(grams).alias("label"))
    return t.join(spark.createDataFrame([(x,) for x in _VOCAB], "label string"), "label").groupBy("chunk_id", "label").agg(F.count("*").alias("hits"))


def _joined(words, n):
    return lambda i: F.array_join(F.slice(words, i, n), " ")


@registry.query(
    f"""WITH {PROFILES}, {PARSED}, s AS (SELECT candidate_id, unnest(from_json(p -> '$.strategies', '["JSON"]')) AS x FROM parsed WHERE json_type(p -> '$.strategies') = 'ARRAY'),
    l AS (SELECT candidate_id, x ->> '$.label' AS label, CAST(x ->> '$.confidence' AS DOUBLE) AS model, CASE json_type(x -> '$.triggers') WHEN 'ARRAY' THEN json_array_length(x -> '$.triggers') ELSE 0 END AS n FROM s WHERE json_type(x) = 'OBJECT'),
    g AS (SELECT candidate_id, label, max(model) AS model, CAST(max(n) AS INT) AS n FROM l WHERE label IS NOT NULL GROUP BY 1, 2)
    SELECT candidate_id, label, round(CASE WHEN n > 0 AND model IS NOT NULL THEN least(0.97, 0.55 + 0.25 * least(1.0, n / 3) + 0.25 * model) WHEN n > 0 THEN least(0.85, 0.35 + 0.14 * n) ELSE least(0.62, model) END, 4) AS confidence, n < 2 AND model IS NULL AS low_support FROM g"""
)
def label_confidence(spark, sf):
    """Confidence of a label from the rule's hits and the model's own, by which of them there is."""
    text = F.get_json_object(P.profile_json(F.col("payload")), "$.strategies")
    items = F.from_json(F.when(F.startswith(text, F.lit("[")), text), "array<string>")
    rows = P.profiles(spark, sf, "payload").select("candidate_id", F.explode(items).alias("x")).where(F.startswith("x", F.lit("{")))
    triggers = F.from_json(F.get_json_object("x", "$.triggers"), "array<string>")
    g = rows.select("candidate_id", F.get_json_object("x", "$.label").alias("label"), F.get_json_object("x", "$.confidence").cast("double").alias("model"), F.coalesce(F.size(triggers), F.lit(0)).alias("n"))
    g = g.where("label is not null").groupBy("candidate_id", "label").agg(F.max("model").alias("model"), F.greatest(F.max("n"), F.lit(0)).alias("n"))
    some = F.col("n") > 0
    both = F.least(F.lit(0.97), 0.55 + 0.25 * F.least(F.lit(1.0), F.col("n") / 3) + 0.25 * F.col("model"))
    value = F.when(some & F.col("model").isNotNull(), both).when(some, F.least(F.lit(0.85), 0.35 + 0.14 * F.col("n"))).otherwise(F.when(F.col("model").isNotNull(), F.least(F.lit(0.62), "model")).otherwise(0.62))
    return g.select("candidate_id", "label", F.round(value, 4).alias("confidence"), ((F.col("n") < 2) & F.col("model").isNull()).alias("low_support"))


@registry.query(
    f"""WITH {ROLES}, p AS (SELECT candidate_id, location, row_number() OVER (PARTITION BY candidate_id ORDER BY s DESC NULLS LAST, seq) AS r FROM roles),
    v AS (SELECT candidate_id, location, sum(CASE r WHEN 1 THEN 12.0 WHEN 2 THEN 6.0 ELSE 1.0 END)::DOUBLE AS votes FROM p WHERE location IS NOT NULL GROUP BY 1, 2),
    t AS (SELECT *, sum(votes) OVER (PARTITION BY candidate_id) AS total, row_number() OVER (PARTITION BY candidate_id ORDER BY votes DESC, location) AS rn FROM v)
    SELECT candidate_id, location, round(least(0.96, 0.4 + 0.6 * votes / total), 4)::DOUBLE AS confidence FROM t WHERE rn = 1"""
)
def geo_vote(spark, sf):
    """The place most roles speak for: the latest role has twelve votes, the one before six, others one."""
    w = Window.partitionBy("candidate_id").orderBy(F.col("s").desc_nulls_last(), "seq")
    r = P.roles(spark, sf).withColumn("r", F.row_number().over(w)).where("location is not null")
    v = r.groupBy("candidate_id", "location").agg(F.sum(F.when(F.col("r") == 1, 12.0).when(F.col("r") == 2, 6.0).otherwise(1.0)).alias("votes"))
    t = v.groupBy("candidate_id").agg(F.sum("votes").alias("total"), F.min_by(F.struct("location", "votes"), F.struct(-F.col("votes"), "location")).alias("b"))
    return t.select("candidate_id", "b.location", F.round(F.least(F.lit(0.96), 0.4 + 0.6 * F.col("b.votes") / F.col("total")), 4).alias("confidence"))


_DEGREES = [("phd", r"\b(ph\.?d|doctor of philosophy|dphil|doctorat|promotion|doctorado|dottorato|doutoramento)\b"), ("mba", r"\b(m\.?b\.?a)\b"), ("masters", r"\b(m\.?sc?|masters?|mestrado)\b"), ("bachelors", r"\b(b\.?sc?|b\.?a|bachelor|licence|licenciatura|grado)\b")]


@registry.query(
    "WITH c AS (SELECT candidate_id, lower(text) AS t FROM chunks WHERE text IS NOT NULL) SELECT candidate_id, min(CASE "
    + " ".join(f"WHEN regexp_matches(t, '{p}') THEN {i + 1}" for i, (_, p) in enumerate(_DEGREES)) + " END) AS best FROM c GROUP BY 1"
)
def degree_level(spark, sf):
    """Rank of the highest degree of a candidate's chunks: the first pattern that matches a text counts."""
    t = F.lower("text")
    level = F.coalesce(*[F.when(F.regexp_like(t, F.lit(p)), i + 1) for i, (_, p) in enumerate(_DEGREES)])
    return load(spark, sf, "chunks").where("text is not null").groupBy("candidate_id").agg(F.min(level).alias("best"))


# ------------------------------------------------------------------ evidence

_CORE = ["region", "country", "seniority_level", "years_experience", "approach", "feeder_path", "source_file", "payload"]


@registry.query(f"WITH {PROFILES} SELECT candidate_id, round((" + " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in _CORE) + f") / {len(_CORE)}.0, 3)::DOUBLE AS completeness FROM profiles")
def completeness(spark, sf):
    return P.profiles(spark, sf).select("candidate_id", F.round(sum((F.col(c).isNotNull().cast("int") for c in _CORE), F.lit(0)) / len(_CORE), 3).alias("completeness"))


@registry.query(
    f"""WITH {ROLES} SELECT candidate_id, round(avg(CASE WHEN evidence_char_start IS NOT NULL THEN 1 ELSE 0 END), 4) AS coverage, count(*) FILTER (start_status = 'missing' OR end_status = 'missing') AS missing,
    count(*) FILTER (start_status = 'verified' AND end_status = 'verified') AS verified FROM roles GROUP BY 1"""
)
def evidence_coverage(spark, sf):
    return P.roles(spark, sf).groupBy("candidate_id").agg(
        F.round(F.avg(F.col("evidence_char_start").isNotNull().cast("int")), 4).alias("coverage"),
        F.count_if((F.col("start_status") == "missing") | (F.col("end_status") == "missing")).alias("missing"),
        F.count_if((F.col("start_status") == "verified") & (F.col("end_status") == "verified")).alias("verified"),
    )


_SPANS = "s AS (SELECT DISTINCT chunk_id, doc_id, char_start, char_end, string_split(label, ' — ')[-1] AS quote FROM chunks WHERE kind = 'role' AND contains(label, ' — '))"


@registry.query(
    f"""WITH {_SPANS} SELECT chunk_id, quote, CASE WHEN d.text IS NULL THEN 'no text' WHEN char_start IS NULL THEN 'no span' WHEN char_start < 0 OR char_end > length(d.text) OR char_end <= char_start THEN 'out of bounds'
    WHEN substr(d.text, char_start + 1, char_end - char_start) = quote THEN 'exact' ELSE 'other' END AS verdict FROM s LEFT JOIN documents d USING (doc_id)"""
)
def span_audit(spark, sf):
    """Whether the evidence of role chunks lies within its own document and says what is claimed."""
    a = _quotes(spark, sf).join(load(spark, sf, "documents").select("doc_id", F.col("text").alias("t")), "doc_id", "left")
    verdict = (
        F.when(F.col("t").isNull(), "no text").when(F.col("char_start").isNull(), "no span")
        .when((F.col("char_start") < 0) | (F.col("char_end") > F.length("t")) | (F.col("char_end") <= F.col("char_start")), "out of bounds")
        .when(F.substring("t", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("quote"), "exact").otherwise("other")
    )
    return a.select("chunk_id", "quote", verdict.alias("verdict"))


def _quotes(spark, sf):
    c = load(spark, sf, "chunks").where("kind = 'role'").where(F.contains("label", F.lit(" — ")))
    return c.select("chunk_id", "doc_id", "char_start", "char_end", F.element_at(F.split("label", " — "), -1).alias("quote")).distinct()


@registry.query(
    f"""WITH {_SPANS}, q AS (SELECT DISTINCT chunk_id, doc_id, quote FROM s), x AS (SELECT chunk_id, quote, CASE WHEN length(trim(quote)) >= 3 THEN instr(d.text, quote) END AS pl FROM q JOIN documents d USING (doc_id))
    SELECT chunk_id, quote, CASE WHEN pl > 0 THEN pl - 1 END AS char_start, CASE WHEN pl > 0 THEN pl - 1 + length(quote) END AS char_end FROM x"""
)
def span_exact(spark, sf):
    """The first rung: where a claimed employer stands verbatim in the document."""
    q = _quotes(spark, sf).select("chunk_id", "doc_id", "quote").distinct()
    both = q.join(load(spark, sf, "documents").select("doc_id", F.col("text").alias("t")), "doc_id")
    return spans.exact_spans(both, "quote", "t").select("chunk_id", "quote", "char_start", "char_end")


@registry.query()
def span_ladder(spark, sf):
    """All rungs; only quotes that the exact rung leaves reach Python."""
    q = _quotes(spark, sf).select("chunk_id", "doc_id", "quote").distinct()
    both = q.join(load(spark, sf, "documents").select("doc_id", F.col("text").alias("t")), "doc_id")
    return spans.span_ladder(both, ["chunk_id", "quote"], "quote", "t")


# ------------------------------------------------------------------ evaluation

@registry.query(
    f"""WITH {_DENSE}, r AS (SELECT query, vec_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INT) AS place FROM dn WHERE query <> vec_id QUALIFY place <= 10),
    g AS (SELECT query, place, CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END AS g FROM r JOIN embeddings a ON a.vec_id = query JOIN embeddings b ON b.vec_id = r.vec_id),
    n AS (SELECT a.vec_id AS query, least(10, count(*) - 1) AS n FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 100 = 0 GROUP BY 1),
    i AS (SELECT query, coalesce((SELECT sum(1 / log2(x + 1)) FROM range(1, n + 1) t(x)), 0) AS idcg FROM n)
    SELECT query, round(CASE WHEN idcg > 0 THEN sum(g / log2(place + 1)) / idcg ELSE 0 END, 4) AS ndcg, round(coalesce(1 / min(CASE WHEN g > 0 THEN place END), 0), 4) AS mrr FROM g JOIN i USING (query) GROUP BY query, idcg"""
)
def eval_ndcg(spark, sf):
    """nDCG@10 and reciprocal rank of dense search; an item of the query's label is relevant."""
    v, q = _vectors(spark, sf)
    hits = S.best(S.dense(v, "vec_id", "embedding", q, 11).where("query <> vec_id").drop("place"), "vec_id", 10)
    labels = v.select("vec_id", "label")
    judged = hits.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query"), F.col("label").alias("own")), "query")
    sizes = v.groupBy("label").agg(F.count("*").alias("n"))
    n = F.least(F.lit(10), F.col("n") - 1).cast("int")
    ideal = q.select(F.col("vec_id").alias("query"), "label").join(sizes, "label").select("query", F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1)).alias("idcg"))
    return E.ndcg_mrr(judged, F.when(F.col("label") == F.col("own"), 1.0).otherwise(0.0), ideal)


@registry.query(
    f"""WITH {_DENSE}, r AS (SELECT query, vec_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS place FROM dn WHERE query <> vec_id QUALIFY place <= 10),
    g AS (SELECT query, place, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS g FROM r JOIN embeddings a ON a.vec_id = query JOIN embeddings b ON b.vec_id = r.vec_id),
    n AS (SELECT a.vec_id AS query, count(*) - 1 AS n FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 100 = 0 GROUP BY 1)
    SELECT query, round(sum(g) FILTER (place <= 5) / 5, 4)::DOUBLE AS precision_5, round(CASE WHEN n > 0 THEN sum(g) / n ELSE 0 END, 6)::DOUBLE AS recall_10 FROM g JOIN n USING (query) GROUP BY query, n"""
)
def eval_recall(spark, sf):
    """Precision of the first five and recall of the first ten of dense search; an item of the query's label is relevant."""
    v, q = _vectors(spark, sf)
    hits = S.best(S.dense(v, "vec_id", "embedding", q, 11).where("query <> vec_id").drop("place"), "vec_id", 10)
    labels = v.select("vec_id", "label")
    own = labels.select(F.col("vec_id").alias("query"), F.col("label").alias("own"))
    g = hits.join(labels, "vec_id").join(own, "query").select("query", "place", "own", (F.col("label") == F.col("own")).cast("int").alias("g"))
    per = g.groupBy("query", "own").agg(F.sum(F.when(F.col("place") <= 5, F.col("g")).otherwise(0)).alias("five"), F.sum("g").alias("ten"))
    n = v.groupBy(F.col("label").alias("own")).agg((F.count("*") - 1).alias("n"))
    return per.join(n, "own").select("query", F.round(F.col("five") / 5, 4).alias("precision_5"), F.round(F.when(F.col("n") > 0, F.col("ten") / F.col("n")).otherwise(0.0), 6).alias("recall_10"))


_RANKED = """ranked AS (SELECT 'lexical' AS mode, query, d, score FROM lexical UNION ALL SELECT 'hashed', query, d, score FROM hashed
        UNION ALL SELECT 'hybrid', query, d, round(sum(1 / (60 + place)), 6) FROM (SELECT query, d, place FROM lexical UNION ALL SELECT query, d, place FROM hashed) GROUP BY 2, 3),
    kept AS (SELECT mode, query, d, row_number() OVER (PARTITION BY mode, query ORDER BY score DESC, d) AS place FROM ranked WHERE query <> d QUALIFY place <= 10)"""


@registry.query(
    f"""WITH {_bm25_rows("SELECT doc_id AS d, coalesce(text, '') AS t FROM documents", 50)}, q AS ({_EACH}), gq AS ({_grams(f"SELECT query AS k, {_HASH_TEXT} AS low FROM q")}), gc AS ({_grams(f"SELECT doc_id AS k, {_HASH_TEXT} AS low FROM documents")}),
    nq AS (SELECT k, sqrt(sum(n * n)) AS size FROM gq GROUP BY 1), nc AS (SELECT k, sqrt(sum(n * n)) AS size FROM gc GROUP BY 1), dots AS (SELECT gq.k AS query, gc.k AS d, sum(gq.n * gc.n) AS dot FROM gq JOIN gc USING (bucket) GROUP BY 1, 2),
    hs AS (SELECT query, d, CAST(round(CAST(round(dot / (nq.size * nc.size), 6) AS DECIMAL(9, 6)), 4) AS DOUBLE) AS score FROM dots JOIN nq ON nq.k = query JOIN nc ON nc.k = d), hashed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, d) AS place FROM hs QUALIFY place <= 50),
    {_RANKED}, rel AS (SELECT a.doc_id AS query, b.doc_id AS d FROM documents a JOIN documents b ON a.candidate_id = b.candidate_id AND a.doc_id <> b.doc_id WHERE a.doc_id % 100 = 0), ideal AS (SELECT query, least(10, count(*)) AS n FROM rel GROUP BY 1),
    dcg AS (SELECT mode, query, sum(1 / log2(place + 1)) AS dcg, min(place) AS first FROM kept JOIN rel USING (query, d) GROUP BY 1, 2), modes(mode) AS (VALUES ('lexical'), ('hashed'), ('hybrid')),
    per AS (SELECT m.mode, i.query, coalesce(dcg, 0) / (SELECT sum(1 / log2(x + 1)) FROM range(1, i.n + 1) t(x)) AS ndcg, coalesce(1 / first, 0) AS mrr FROM ideal i CROSS JOIN modes m LEFT JOIN dcg ON dcg.mode = m.mode AND dcg.query = i.query)
    SELECT mode, count(*) AS queries, round(avg(ndcg), 4) AS ndcg, round(avg(mrr), 4) AS mrr FROM per GROUP BY 1"""
)
def eval_ablation(spark, sf):
    """Three ways of search side by side, asked by every document whose id is divisible by 100: what belongs to the same
    candidate is relevant. Documents without another of their candidate are no queries."""
    docs = load(spark, sf, "documents")
    lexical = S.bm25_rows(docs, "doc_id", F.col("text"), _asked_rows(spark, sf), "doc_id", F.coalesce("text", F.lit("")), 50).select("query", "doc_id", "score", "place")
    vectors = S.hashed_text_vectors(docs, "doc_id", "text")
    asked = S.hashed_text_vectors(_asked_rows(spark, sf), "doc_id", "text")
    hashed = S.dense(vectors, "doc_id", "v", asked, 50).where("score > 0").select("query", "doc_id", "score", "place")
    # fifty rows a query, each read by two ways of search
    lexical, hashed = materialise(lexical, "lexical"), materialise(hashed, "hashed")
    modes = {"lexical": lexical, "hashed": hashed, "hybrid": S.rrf([lexical, hashed], "doc_id", 100)}
    d = docs.where("candidate_id is not null")
    rel = d.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), "candidate_id").join(d.select("doc_id", "candidate_id"), "candidate_id").where("query <> doc_id").select("query", "doc_id")
    ideal = rel.groupBy("query").agg(F.least(F.lit(10), F.count("*")).cast("int").alias("n"))
    best = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    out = None
    for mode, ranking in modes.items():
        kept = S.best(ranking.where("query <> doc_id").select("query", "doc_id", "score"), "doc_id", 10)
        dcg = kept.join(rel, ["query", "doc_id"]).groupBy("query").agg(F.sum(1 / F.log2(F.col("place") + 1)).alias("dcg"), F.min("place").alias("first"))
        per = ideal.join(dcg, "query", "left").select(F.lit(mode).alias("mode"), (F.coalesce("dcg", F.lit(0.0)) / best).alias("ndcg"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))
        out = per if out is None else out.unionByName(per)
    return out.groupBy("mode").agg(F.count("*").alias("queries"), F.round(F.avg("ndcg"), 4).alias("ndcg"), F.round(F.avg("mrr"), 4).alias("mrr"))


@registry.query(
    f"""{ALL}, pr AS (SELECT candidate_id, list(DISTINCT strategy) AS a FROM strategies GROUP BY 1), ch AS (SELECT candidate_id, list(DISTINCT skill) AS b FROM skills GROUP BY 1),
    dp AS (SELECT candidate_id, list(DISTINCT skill) AS c FROM skills WHERE depth <> 'mentioned' GROUP BY 1),
    s AS (SELECT candidate_id, coalesce(b, []) AS g, coalesce(c, []) AS p FROM profiles LEFT JOIN ch USING (candidate_id) LEFT JOIN dp USING (candidate_id)),
    n AS (SELECT candidate_id, len(list_intersect(p, g)) AS h, len(p) AS np, len(g) AS ng FROM s)
    SELECT candidate_id, round(CASE WHEN np = 0 AND ng = 0 THEN 1 WHEN np = 0 THEN 0 ELSE h / np END, 4)::DOUBLE AS precision, round(CASE WHEN np = 0 AND ng = 0 THEN 1 WHEN ng = 0 THEN 0 ELSE h / ng END, 4)::DOUBLE AS recall,
        round(CASE WHEN np = 0 AND ng = 0 THEN 1 WHEN h = 0 THEN 0 ELSE 2 * h / (np + ng) END, 4)::DOUBLE AS f1 FROM n"""
)
def eval_prf(spark, sf):
    """Precision, recall and F1 of the used skills against the listed ones."""
    s = P.skills(spark, sf)
    gold = s.groupBy("candidate_id").agg(F.collect_set("skill").alias("g"))
    used = s.where("depth <> 'mentioned'").groupBy("candidate_id").agg(F.collect_set("skill").alias("p"))
    empty = F.array().cast("array<string>")
    both = load(spark, sf, "candidates").select("candidate_id").distinct().join(gold, "candidate_id", "left").join(used, "candidate_id", "left")
    return both.select("candidate_id", F.coalesce("g", empty).alias("g"), F.coalesce("p", empty).alias("p")).select("candidate_id", *[c.alias(k) for k, c in E.set_scores(F.col("p"), F.col("g")).items()])


@registry.query(
    """WITH x AS (SELECT extraction_quality AS c, CASE WHEN text IS NOT NULL AND length(text) >= 200 THEN 1.0 ELSE 0.0 END AS y FROM documents WHERE extraction_quality IS NOT NULL),
    b AS (SELECT min(c) AS lo, CASE WHEN max(c) > min(c) THEN (max(c) - min(c)) / 5 ELSE 1 END AS w FROM x)
    SELECT CAST(least(4, floor((c - lo) / w)) AS INT) AS bin, count(*) AS n, round(avg(c), 4) AS mean_confidence, round(avg(y), 4)::DOUBLE AS accuracy, round(avg(pow(c - y, 2)), 4) AS brier FROM x, b GROUP BY 1"""
)
def eval_calibration(spark, sf):
    """Reliability of the recorded extraction quality as a confidence that a usable text came out."""
    x = load(spark, sf, "documents").where("extraction_quality is not null").select(F.col("extraction_quality").alias("c"), F.when(F.length("text") >= 200, 1.0).otherwise(0.0).alias("y"))
    return E.calibration(x, "c", "y")
