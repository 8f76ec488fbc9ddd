import math
import re
import sqlite3

import numpy as np
from pyspark.sql import functions as F

from lodestar.operators import evaluate as E
from lodestar.operators import search as S
from lodestar.operators import spans


def test_bm25_same_as_sqlite(spark):
    docs = [(1, "credit risk model"), (2, "credit credit desk with a longer text about banks"), (3, "nothing here"), (4, "risk"), (5, "banks and more banks"), (6, "model of a bank")]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(body)")
    con.executemany("INSERT INTO t(rowid, body) VALUES (?, ?)", docs)
    want = {r[0]: round(-r[1], 4) for r in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH '\"credit\" OR \"risk\"'")}
    df = spark.createDataFrame(docs, "id int, t string")
    got = {r.id: r.score for r in S.bm25(df, "id", F.col("t"), [("q", "credit risk?")], 10).collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], abs_tol=2e-4) for k in want)


def test_bm25_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "word " * 50_000 + "rare", 0), (3, "rare", 0)], "id int, t string, score int")
    assert {r.id for r in S.bm25(df, "id", F.col("t"), [("q", "rare"), ("none", "absent")], 5).collect()} == {3}
    assert S.bm25(df.limit(0), "id", F.col("t"), [("q", "rare")], 5).count() == 0


def test_bm25_of_query_rows(spark):
    docs = [(i, " ".join(f"w{(i * 7 + j) % 90}" for j in range(40))) for i in range(200)] + [(200, None), (201, "")]
    df = spark.createDataFrame(docs, "id int, t string")
    asked = [("a", "w1 w2 w3 w3"), ("long", " ".join(f"w{i}" for i in range(89, -1, -1))), ("short", "x absent"), ("none", None)]
    got = S.bm25_rows(df, "id", F.col("t"), spark.createDataFrame(asked, "q string, x string"), "q", F.col("x"), 300).collect()
    # the same as by lists of at most 32 terms, whose scores add up over parts of a query
    parts = [("a", asked[0][1]), *((f"long{i}", " ".join(asked[1][1].split()[30 * i : 30 * i + 30])) for i in range(3))]
    want = {}
    for r in S.bm25(df, "id", F.col("t"), parts, 300).collect():
        key = (r["query"].rstrip("012"), r.id)
        want[key] = want.get(key, 0) + r.score
    have = {(r["query"], r.id): r.score for r in got}
    assert set(have) == set(want) and all(abs(have[k] - want[k]) < 2e-4 for k in want)
    assert S.bm25_rows(df, "id", F.col("t"), spark.createDataFrame(asked[2:], "q string, x string"), "q", F.col("x"), 5).count() == 0


def test_every_hundredth_document_asks(spark):
    from lodestar.plans.core import registry

    sf = "/root/testdata/sf0.01"
    ids = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 100 = 0 and text rlike '[a-z]{3}'").collect()}
    for name in ("bm25_topk_rows", "rrf_hybrid_rows", "hash_embedding_topk_rows"):
        assert ids <= {r["query"] for r in registry.queries[name](spark, sf).select("query").distinct().collect()}, name


def test_dense_same_as_numpy(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)] + [(300, None)], "id int, v array<double>")
    got = S.dense(df, "id", "v", df.where("id % 100 = 0"), 5).collect()
    for q in (0, 100, 200):
        score = np.round(v @ v[q], 4)
        want = sorted(range(300), key=lambda i: (-score[i], i))[:5]
        assert [r.id for r in sorted((r for r in got if r["query"] == q), key=lambda r: r.place)] == want
    assert S.dense(df.limit(0), "id", "v", df.limit(0), 5).count() == 0


def test_dense_ties_go_to_the_least_ids(spark):
    # copies fill most of each batch, in descending order of id; some differ only behind the fourth decimal
    same = [(i, [1.0, 0.00001 * (i % 3)]) for i in range(3000, 0, -1)]
    df = spark.createDataFrame([*same, (0, [1.0, 1.0]), (5000, [0.99995, 0.0])], "id int, v array<double>").coalesce(1)
    got = S.dense(df, "id", "v", df.where("id = 0"), 10).orderBy("place").collect()
    assert [r.id for r in got] == list(range(10)) and [r.score for r in got][1:] == [1.0] * 9
    words = df.select(F.format_string("n%05d", "id").alias("id"), "v")
    got = S.dense(words, "id", "v", words.where("id = 'n00000'"), 10).orderBy("place").collect()
    assert [r.id for r in got] == [f"n{i:05d}" for i in range(10)]


def test_batch_best_rounds_as_spark_does(spark):
    rng = np.random.default_rng(4)
    score = np.round(rng.integers(-3000, 3000, (5, 400)) / 2e5, 6)  # many halves of the fourth decimal
    rank = rng.permutation(400)
    rows = spark.createDataFrame([(q, int(rank[j]), float(score[q, j])) for q in range(5) for j in range(400)], "query int, i int, score double")
    want = {(r["query"], r.i) for r in S.best(rows.withColumn("score", F.round("score", 4)), "i", 17).collect()}
    which, top = S._batch_best(score, rank, 17)
    assert {(int(q), int(rank[j])) for q, j in zip(which, top)} == want and len(which) == 5 * 17


def test_vectors_of_texts_in_one_pass(spark):
    texts = ["Credit, risk & C++ models", "", None, "a", "ab c", "abcde", "été É 123\t9", "   ", "𝔘nicode 😀 tail", "word " * 4000 + "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    want = {r.id: r.v for r in S.hashed_vectors(S.hashed_grams(df, "id", "t"), "id").collect()}
    got = S.hashed_text_vectors(df, "id", "t")
    assert {r.id: r.v for r in got.collect()} == want and len(want) == 7
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    assert S.hashed_text_vectors(df.limit(0), "id", "t").count() == 0


def test_ablation_searches_once(spark, monkeypatch):
    from lodestar.plans import search as plans
    from lodestar.plans.core import registry

    written, keep = [], plans.materialise
    monkeypatch.setattr(plans, "materialise", lambda df, name: written.append(name) or keep(df, name))
    plan = registry.queries["eval_ablation"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert written == ["lexical", "hashed"] and "MapInArrow" not in plan


def test_fusion_is_by_rank_only(spark):
    a = spark.createDataFrame([("q", "a", 1, 900.0), ("q", "b", 2, 1.0)], "query string, id string, place int, score double")
    b = spark.createDataFrame([("q", "b", 1, 0.2), ("q", "a", 2, 0.1)], "query string, id string, place int, score double")
    got = {r.id: r.score for r in S.rrf([a, b], "id", 5).collect()}
    assert got["a"] == got["b"] == round(1 / 61 + 1 / 62, 6)


def test_best_item_not_sum(spark):
    rows = [("q", f"w{i}", "many", 1.0) for i in range(20)] + [("q", "p", "one", 5.0)]
    got = S.best_per_entity(spark.createDataFrame(rows, "query string, item string, who string, score double"), "item", "who").orderBy(F.desc("score")).collect()
    assert [r.who for r in got] == ["one", "many"] and got[1].score == 1.0 and got[1]["items"] == ["w0", "w1", "w10"]


def test_spans(spark):
    text = "Ann worked at Coppergate Gantry Capital, then left."
    rows = [("e", "Coppergate Gantry Capital", text), ("n", "COPPERGATE   gantry capital", text), ("f", "Coppergate Gantri Capital", text), ("x", "Invented Holdings Bank", text), ("s", "An", text), ("z", None, text), ("y", "Ann", None)]
    got = {r.id: r for r in spans.span_ladder(spark.createDataFrame(rows, "id string, q string, t string"), ["id"], "q", "t").collect()}
    assert {k: r.kind for k, r in got.items()} == {"e": "exact", "n": "normalized", "f": "fuzzy", "x": "none", "s": "none", "z": "none", "y": "none"}
    for k in ("e", "n", "f"):
        assert text[got[k].char_start : got[k].char_end] == "Coppergate Gantry Capital"
    assert got["x"].char_start is None


def test_metrics(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], []), ([], ["a"])], "p array<string>, g array<string>")
    got = [tuple(r) for r in df.select(*[c.alias(k) for k, c in E.set_scores(F.col("p"), F.col("g")).items()]).collect()]
    assert got == [(0.5, 0.5, 0.5), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
    cal = E.calibration(spark.createDataFrame([(0.0, 0.0), (0.1, 0.0), (1.0, 1.0), (None, 1.0)], "c double, y double"), "c", "y").collect()
    assert sum(r.n for r in cal) == 3 and len(cal) == 2
    p = E.nearest_rank(spark.createDataFrame([("a", float(i)) for i in range(10)], "g string, v double"), "g", "v", [0.5, 0.95]).first()
    assert (p.p50, p.p95) == (5.0, 9.0) or (p.p50, p.p95) == (4.0, 9.0)
    assert re.match("p", "p50")


def test_fusion_under_a_union_that_claims_a_partitioning(spark):
    """The sides of the fusion come out of aggregates by the same key; every item must be fused all the same."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "true")
    try:
        base = spark.createDataFrame([("q", i, i + 1) for i in range(40)], "query string, id int, place int")
        side = lambda: base.groupBy("query", "id").agg({"place": "max"}).toDF("query", "id", "place")
        got = S.rrf([side(), side()], "id", 40).collect()
    finally:
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    assert len(got) == 40 and {r.id: round(r.score, 6) for r in got} == {i: round(2 / (61 + i), 6) for i in range(40)}
