import json

from lodestar.operators.nested import canonical, links, merkle, nodes, profile_children, shred


def test_identities():
    a, b = {"x": [1, {"y": None}], "z": "é"}, {"z": "é", "x": [1, {"y": None}]}
    assert merkle(a) == merkle(b) and canonical(a) == canonical(b)
    assert merkle({"x": [1, 2]}) != merkle({"x": [2, 1]}) and merkle("1") != merkle(1) and merkle([]) != merkle({})


PROFILE = {
    "strategies": [{"label": "a", "triggers": ["t1", "t2"]}, "bare", {"confidence": 1, "triggers": "lone"}, {"label": "a", "triggers": ["t1", "t2"]}],
    "employment": {"highlights": [{"value": "h"}, "s"]},
    "ext": {"vendor": {"strategies": [{"label": "not ours"}]}},
}


def test_children(spark):
    rows = [
        ("c1", json.dumps({"data": PROFILE}), "2025-01-02 00:00:00"), ("c1", json.dumps({"data": {"strategies": ["old"]}}), "2025-01-01 00:00:00"), ("c1", json.dumps({"data": PROFILE}), "2025-01-02 00:00:00"),
        ("c2", json.dumps(json.dumps(PROFILE)), "2025-01-01 00:00:00"), ("c3", '{"data": {"strategies": [', "2025-01-01 00:00:00"), ("c4", None, None), ("c5", "", None), ("c6", '{"strategies": null, "employment": []}', None),
        (None, '{"strategies": "x"}', None), ("c7", '"' + "y" * 50_000, None), ("c8", json.dumps({"strategies": {"label": "one"}}), None),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "candidate_id string, payload string, at string, label string").selectExpr("candidate_id", "payload", "cast(at as timestamp) updated_at", "label", "label child")
    got = sorted((tuple(r) for r in profile_children(df).collect()), key=str)
    want = []
    for c in ("c1", "c2"):
        want += [(c, "strategy", -1, i, x) for i, x in enumerate(["a", "bare", "", "a"])]
        want += [(c, "trigger", 0, 0, "a"), (c, "trigger", 0, 1, "a"), (c, "trigger", 2, 0, ""), (c, "trigger", 3, 0, "a"), (c, "trigger", 3, 1, "a")]
        want += [(c, "role", -1, 0, ""), (c, "highlight", 0, 0, ""), (c, "highlight", 0, 1, "")]
    want += [(None, "strategy", -1, 0, "x"), ("c8", "strategy", -1, 0, "one")]
    assert got == sorted(want, key=str)
    assert profile_children(df.limit(0)).count() == 0


def test_equal_objects_are_stored_once(spark):
    df = spark.createDataFrame([("c1", json.dumps(PROFILE)), ("c2", json.dumps(PROFILE))], "id string, payload string")
    s = shred(df, "id", "payload").cache()
    assert s.count() == 2 * 12 and nodes(s).count() == len({r.node_id for r in s.collect()}) < 12
    parents = {r.node_id for r in s.collect()} | {merkle(PROFILE)}
    assert {r.parent_id for r in links(s).collect()} <= parents
    assert {r.place for r in s.where("branch = 'strategies[].triggers' and record_id = 'c1'").collect()} == {"/strategies:0/triggers:0", "/strategies:0/triggers:1", "/strategies:2/triggers:0", "/strategies:3/triggers:0", "/strategies:3/triggers:1"}
    assert {r.branch for r in shred(df, "id", "payload", ("ext.vendor",)).collect()} == set()


def rebuilt(body, bodies):
    """A value from its node's body, with identities replaced by what they stand for."""
    def fill(v):
        if isinstance(v, dict):
            return {k: fill(x) for k, x in v.items()}
        if isinstance(v, list):
            return [fill(x) for x in v]
        return rebuilt(bodies[v[1:]], bodies) if isinstance(v, str) and v[1:] in bodies else v

    return fill(json.loads(body))


def test_bodies_hold_the_identities_of_their_children(spark):
    """Every listed element can be put together again from bodies that hold no element twice."""
    value = {"strategies": PROFILE["strategies"], "employment": [{"highlights": [{"value": "h", "evidence": [{"at": 1}]}, "s"], "dates": {"start": "2020"}}]}
    df = spark.createDataFrame([("c1", json.dumps(value)), ("c2", json.dumps(value))], "id string, payload string")
    for branches in (("strategies", "strategies[].triggers", "employment", "employment[].highlights"), None):
        s = shred(df, "id", "payload", branches)
        bodies = {r.node_id: r.body for r in nodes(s).collect()}
        rows = links(s).where("record_id = 'c2'").collect()
        found = {(r.branch, r.parent_pos, r.pos): rebuilt(bodies[r.node_id], bodies) for r in rows}
        lone = lambda v: v if isinstance(v, list) else [v]
        for i, v in enumerate(value["strategies"]):
            want = {**v, "triggers": lone(v["triggers"])} if isinstance(v, dict) and "triggers" in v else v
            assert found[("strategies", -1, i)] == want or branches is None
        role = found[("employment", -1, 0)]
        assert role["highlights"][0]["value"] == "h" and (role["dates"] == {"start": "2020"} or branches is None)
        if branches is None:  # every array and object has rows, whatever it is called
            assert {r.branch for r in rows} >= {"employment[].dates", "employment[].highlights[].evidence", "strategies"}


def test_very_deep_records(spark):
    deep = '{"strategies": ' + "[" * 3000 + "]" * 3000 + "}"
    df = spark.createDataFrame([("a", deep), ("b", '{"strategies": ["x"]}'), ("c", json.dumps(json.dumps(json.dumps({"strategies": "y"})) * 1))], "id string, payload string")
    got = {r.record_id for r in shred(df, "id", "payload").collect()}
    assert {"b", "c"} <= got
