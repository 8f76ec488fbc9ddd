import random

from lodestar.llm.leaks import leaked_passages, suffix_array, without_leaks, words_of
from lodestar.llm import leaks
import numpy as np


def brute(docs, items, n):
    out = set()
    for d, x in docs:
        w = words_of(x or "")
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for k, y in items:
            v = words_of(y or "")
            if any(tuple(v[i : i + n]) in grams for i in range(len(v) - n + 1)):
                out.add((d, k))
    return out


def test_same_pairs_as_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "B", "c1", "Éa", "x"])
    docs = [(i, " ,".join(word() for _ in range(rng.randrange(40)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, " \n "), (1, docs[1][1]), (63, "zz " * 20000 + docs[3][1])]
    items = [(i, "\n".join(word() for _ in range(rng.randrange(14)))) for i in range(40)] + [(40, None), (41, ""), (None, "b c1 c1 x")]
    left = spark.createDataFrame([(*r, "w") for r in docs], "doc_id bigint, text string, words string")
    right = spark.createDataFrame([(*r, "w") for r in items], "item_id bigint, text string, doc_id string")
    for block in (10, 10_000):
        got = leaked_passages(left, "doc_id", "text", right, "item_id", "text", 4, block)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == brute(docs, items, 4)
    rest = {r.doc_id for r in without_leaks(left, "doc_id", got).collect()}
    assert rest == {d for d, _ in docs} - {d for d, _ in brute(docs, items, 4)}
    assert leaked_passages(left.limit(0), "doc_id", "text", right, "item_id", "text").count() == 0
    assert leaked_passages(left, "doc_id", "text", right.limit(0), "item_id", "text").count() == 0


def test_longest_match_and_place(spark):
    a = spark.createDataFrame([(1, "Intro: one TWO—three four. five end")], "doc_id bigint, text string")
    b = spark.createDataFrame([(9, "zero one two three four five six")], "item_id bigint, text string")
    (r,) = leaked_passages(a, "doc_id", "text", b, "item_id", "text", 3).collect()
    assert (r.words, r.item_word, r.doc_char) == (5, 1, 7)


def test_suffix_order():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(1, 3, 50), [0], rng.integers(1, 3, 30), [0]]).astype(np.int32)
    at = leaks._whole(ids, 3)
    tail = lambda p: [int(x) for x in ids[p : p + list(ids[p:]).index(0)]]
    got = [tail(p) for p in suffix_array(ids, at, 3)]
    assert got == sorted(got)


def test_case_is_ignored_in_full(spark):
    """Capitals of ß are two letters."""
    text = "die große Straße führt außen am Fluß vorbei und weiter bis zum Schloß hinauf in den Wald"
    a = spark.createDataFrame([(1, text.upper()), (2, text.lower())], "doc_id bigint, text string")
    b = spark.createDataFrame([(9, text)], "item_id bigint, text string")
    assert {r.doc_id for r in leaked_passages(a, "doc_id", "text", b, "item_id", "text").collect()} == {1, 2}


def test_many_occurrences_in_small_steps(spark, monkeypatch):
    """Boilerplate shared by many items and documents, extended a few pairs at a time."""
    monkeypatch.setattr(leaks, "PAIRS", 7)
    line = "one two three four five six seven eight nine ten eleven twelve thirteen"
    items = [(f"i{k}", f"{line} item{k}") for k in range(9)]
    block = leaks.TestBlock(items, 12)
    got = list(leaks.shard_matches(block, [f"x{d} {line} tail{d}" for d in range(11)]))
    assert {(d, i) for d, i, *_ in got} == {(d, i) for d in range(11) for i in range(9)} and {r[2] for r in got} == {13}
