import random
import re

import numpy as np

from lodestar.llm.neardup import MINIMA, candidate_pairs, classes, deduplicated, minima, near_duplicate_groups, near_duplicate_pairs, shingle_sets


def sets_of(texts, k=5):
    out = []
    for t in texts:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    return out


def corpus(seed, n=120, length=60):
    rng = random.Random(seed)
    bases = [[rng.choice("abcdefghijklmno") + str(rng.randrange(40)) for _ in range(length)] for _ in range(n // 4)]
    docs = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = "é new" + str(rng.randrange(900))
        docs.append(("—\n ".join(w)).upper() if i % 3 == 0 else " ".join(w))
    return docs


def test_shingle_sets_same_as_by_hand():
    texts = ["", "one two three four", "A b-c d E f", "x" * 100_000, "a b c d e a b c d e a b c d e", "ÉÀ a1 b2\xa0c3 d4 e5 ﬁ f6", *corpus(1, 40)]
    hashes, offsets = shingle_sets(texts)
    want = sets_of(texts)
    assert [int(x) for x in np.diff(offsets)] == [len(s) for s in want]
    # the same shingle has the same hash wherever it stands
    for a in range(6, 20):
        for b in range(a):
            x, y = (set(hashes[offsets[i] : offsets[i + 1]].tolist()) for i in (a, b))
            assert len(x & y) == len(want[a] & want[b])


def test_minima_estimate_similarity():
    hashes, offsets = shingle_sets([" ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(60, 360))])
    m = minima(hashes, offsets[:-1])
    a, b = (set(hashes[offsets[i] : offsets[i + 1]].tolist()) for i in (0, 1))
    assert abs((m[0] == m[1]).mean() - len(a & b) / len(a | b)) < 4 * (0.25 / MINIMA) ** 0.5


def test_pairs_and_groups_same_as_brute_force(spark):
    texts = corpus(7)
    docs = list(enumerate(texts)) + [(200, None), (201, ""), (202, "a b c d"), (203, texts[5]), (204, texts[5]), (205, texts[9].lower() + " !"), (None, texts[5]), (206, "deep " * 30_000)]
    s = dict(zip([i for i, _ in docs if i is not None], sets_of([t for i, t in docs if i is not None])))
    ids = sorted(s)
    df = spark.createDataFrame([(*d, 1, "x") for d in docs + [docs[3]]], "doc_id bigint, text string, size int, class string").repartition(5)
    for threshold in (0.55, 0.8):
        want = {(a, b) for a in ids for b in ids if a < b and s[a] and s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= threshold}
        got = near_duplicate_pairs(df, "doc_id", "text", threshold).collect()
        assert {(r.doc_id_a, r.doc_id_b) for r in got} == want and len(got) == len(want) and want
        for r in got:
            assert abs(r.jaccard - len(s[r.doc_id_a] & s[r.doc_id_b]) / len(s[r.doc_id_a] | s[r.doc_id_b])) < 1e-9
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(want):
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    groups = {r.doc_id: r.group_id for r in near_duplicate_groups(df, "doc_id", "text", 0.8).collect()}
    assert groups == {i: find(i) for i in ids}
    assert near_duplicate_pairs(df.limit(0), "doc_id", "text").count() == 0
    assert near_duplicate_groups(df.limit(0), "doc_id", "text").count() == 0


def test_a_hot_group_of_copies_is_one_class(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(i, text) for i in range(400)] + [(400, text.replace("w7 ", "z "))], "doc_id bigint, text string")
    sig = classes(df, "doc_id", "text")
    assert sig.select("class").distinct().count() == 2 and sig.count() == 401
    assert candidate_pairs(deduplicated(sig), 0.8).count() == 1
    assert {r.group_id for r in near_duplicate_groups(df, "doc_id", "text", 0.8).collect()} == {0}


def test_a_hot_band_can_be_split(spark):
    """Both sides of the join on the band's key come straight from a shuffle, and no class is lost in a hot band."""
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base[:200] + [f"x{i}"] + base[200:]) for i in range(60)]  # 60 classes that share nearly all bands
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = candidate_pairs(deduplicated(classes(df, "doc_id", "text")), 0.8)
        plan = [x.lstrip(" :+-*(0123456789)").split(" ")[0].split("(")[0] for x in pairs._jdf.queryExecution().executedPlan().toString().splitlines()]
        assert all(plan[i + 1] == "Exchange" for i, x in enumerate(plan) if x == "Sort")
        assert pairs.count() == 60 * 59 // 2
        got = near_duplicate_groups(df, "doc_id", "text", 0.8).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r.group_id, r.n_links) for r in got} == {(0, 59)} and len({r.class_id for r in got}) == 60
