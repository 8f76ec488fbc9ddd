import pytest
from pyspark.sql import functions as F

from lodestar.operators import index as IX
from lodestar.operators import search as S
from lodestar.operators.texts import shingle_classes, shingle_pairs

TEXTS = [("a", "credit risk of banks, credit index"), ("b", "Energy credit; risk"), ("c", None), ("d", ""), ("e", "banks " * 3000), ("f", "ähnlich énergie"), ("a", "credit risk of banks, credit index")]
QUERIES = [("q1", "credit risk"), ("q2", "banks énergie"), ("q3", "nothing"), ("q4", "")]


def test_same_as_without_index(spark, tmp_path):
    df = spark.createDataFrame([(*t, 1) for t in TEXTS], "id string, t string, len int")
    path = f"{tmp_path}/index"
    with pytest.raises(IX.StaleIndex):
        IX.opened(spark, path)
    IX.build(df, "id", "t", path)
    manifest = IX.opened(spark, path, df, "id", "t")
    assert manifest["texts"] == len(TEXTS)
    got = {tuple(r) for r in IX.search(spark, path, manifest, "id", QUERIES, 5).select("query", "id", "score", "place").collect()}
    # repeated keys with equal texts count as one text of the postings, as they do in the search without an index
    assert got == {tuple(r) for r in S.bm25(df, "id", F.col("t"), QUERIES, 5).select("query", "id", "score", "place").collect()} and got


def test_other_texts_are_noticed(spark, tmp_path):
    df = spark.createDataFrame(TEXTS, "id string, t string")
    path = f"{tmp_path}/index"
    IX.build(df, "id", "t", path)
    for other in (df.limit(3), df.withColumn("t", F.upper("t")), df.unionByName(df.limit(1))):
        with pytest.raises(IX.StaleIndex):
            IX.opened(spark, path, other, "id", "t")
    empty = f"{tmp_path}/empty"
    IX.build(df.limit(0), "id", "t", empty)
    assert IX.search(spark, empty, IX.opened(spark, empty, df.limit(0), "id", "t"), "id", QUERIES, 5).count() == 0


def test_files_as_they_were_are_not_read_again(spark, tmp_path, monkeypatch):
    source, path = f"{tmp_path}/texts", f"{tmp_path}/index"
    spark.createDataFrame(TEXTS, "id string, t string").write.parquet(source)
    IX.build(spark.read.parquet(source), "id", "t", path)
    monkeypatch.setattr(IX, "fingerprint", lambda *_: pytest.fail("the texts were read"))
    assert IX.opened(spark, path, spark.read.parquet(source), "id", "t")["texts"] == len(TEXTS)
    monkeypatch.undo()
    spark.createDataFrame([("z", "new")], "id string, t string").write.mode("append").parquet(source)
    with pytest.raises(IX.StaleIndex):
        IX.opened(spark, path, spark.read.parquet(source), "id", "t")


def test_search_reads_the_folders_of_its_terms(spark, tmp_path):
    df = spark.createDataFrame(TEXTS, "id string, t string")
    path = f"{tmp_path}/index"
    IX.build(df, "id", "t", path)
    plan = IX.search(spark, path, IX.opened(spark, path), "id", QUERIES[:1], 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(", "").replace("PartitionFilters: [isnotnull", "PartitionFilters: [") or "bucket" in plan.split("PartitionFilters:")[1][:200]


def test_classes_lose_no_document(spark):
    base = "one two three four five six seven eight"
    rows = [(1, base), (2, base.upper() + "!"), (3, base + " nine"), (4, "a b c d"), (5, None), (6, ""), (7, base)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id int, t string, class_id string")
    members = {r.id: (r.class_id, r.copies) for r in shingle_classes(df, "id", "t").collect()}
    assert members == {1: (1, 3), 2: (1, 3), 7: (1, 3), 3: (3, 1)}
    assert {(r.id_a, r.id_b) for r in shingle_pairs(df, "id", "t", 0.5).collect()} == {(1, 3)}
    assert shingle_classes(df.limit(0), "id", "t").count() == 0


def test_windows_lose_no_alignment():
    """Aligning only near unchanged pieces finds what aligning with the whole text finds."""
    import random

    from lodestar.operators import spans

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 8)))
    for _ in range(150):
        quote = " ".join(word() for _ in range(rng.randrange(2, 7)))
        near = list(quote)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(near))
            near[i : i + 1] = rng.choice([[], ["z"], near[i : i + 1] * 2])
        text = " ".join([word() for _ in range(20)] + ["".join(near)] + [word() for _ in range(20)])
        kind, score, a, b = spans.locate(quote, text)
        quote, text = spans.fold_with_map(quote)[0], spans.fold_with_map(text)[0]  # blanks squeezed
        share, lo, hi = spans.align(quote, text)
        if quote in text:
            assert kind == "normalized"
        else:
            assert (kind, score) == (("fuzzy", round(share, 4)) if share >= spans.THRESHOLD and hi > lo else ("none", 0.0)), (quote, text)
