"""Deeply nested JSON records as related flat tables with Merkle identities.

Every object and array element is hashed bottom-up over its canonical form, so that equal
subtrees have equal ids wherever they stand. `nodes` holds each distinct element once, with the ids of
its child elements in place of them; `links` holds every occurrence with its place: the record, the
branch, the position and the parent's.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from ..tables import load

#: The branches of a candidate's profile that become child tables.
PROFILE_BRANCHES = ("strategies", "strategies[].triggers", "employment", "employment[].highlights")

#: Levels of nesting that are followed; deeper text is unreadable, as the JSON reader itself gives up.
DEPTH = 50_000

_SHRED_SCHEMA = (
    "record_id string, branch string, parent_pos int, pos int, place string, "
    "parent_id string, node_id string, node_kind string, body string"
)


_text = json.encoder.encode_basestring
_encode = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode


def canonical(value) -> str:
    """JSON text that is equal for equal values: sorted keys, no blanks, no escapes but the needed."""
    return _text(value) if type(value) is str else _encode(value)


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def _scalar(value) -> str:
    kind = type(value)
    if kind is str:
        return _text(value)
    if kind is float and value - value == 0:  # finite
        return repr(value)
    return _encode(value)


class Subtree:
    """An object or array with its identity, and the subtrees right below it by field or position."""

    __slots__ = ("id", "parts")

    def __init__(self, value: dict | list) -> None:
        parts = {}
        form = []
        if isinstance(value, dict):
            for k in sorted(value):
                v = value[k]
                if type(v) is dict or type(v) is list:
                    parts[k] = part = Subtree(v)
                    form.append(f"{_text(k)}:#{part.id}")
                else:
                    form.append(f"{_text(k)}:{_scalar(v)}")
            text = "{" + ",".join(form)
        else:
            for i, v in enumerate(value):
                if type(v) is dict or type(v) is list:
                    parts[i] = part = Subtree(v)
                    form.append(f"#{part.id}")
                else:
                    form.append(_scalar(v))
            text = "[" + ",".join(form)
        self.id, self.parts = _digest(text), parts


def merkle(value) -> str:
    """Identity of a value, from its scalars and the identities of its subtrees."""
    return Subtree(value).id if isinstance(value, (dict, list)) else _digest(canonical(value))


def read_profile(payload: str | None):
    """The profile object of a payload, or None where the payload can't be read.

    A payload that is a JSON string is read through; the profile is `data`, or the top level
    where `data` is absent.
    """
    value = payload
    while isinstance(value, str):  # each time shorter, so it ends
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
    if isinstance(value, dict):
        value = value.get("data", value)
    return value if isinstance(value, dict) else None


class Walk:
    """The elements of the wanted branches of one record, from subtrees that are hashed once, bottom-up."""

    def __init__(self, branches: tuple[str, ...] | None) -> None:
        self.wanted = None if branches is None else frozenset(branches)
        self.inner = None if branches is None else frozenset("[].".join(b.split("[].")[: i + 1]) for b in branches for i in range(b.count("[].") + 1))

    def follows(self, branch: str, value) -> bool:
        """Whether a field's elements have rows. Without a list of branches all objects and arrays do."""
        return isinstance(value, (dict, list)) if self.inner is None else branch in self.inner

    @staticmethod
    def elements(value, own: Subtree | None) -> list[tuple]:
        """(element, its subtree) of a field; a lone value stands for an array of one, null for none."""
        if isinstance(value, list):
            return [(v, own.parts.get(i)) for i, v in enumerate(value)]
        return [] if value is None else [(value, own)]

    def body(self, value, own: Subtree | None, prefix: str) -> str:
        """Canonical JSON of an element; elements that have rows of their own stand as their identities, in their order."""
        if not isinstance(value, dict):
            return canonical(value)
        out = []
        for k in sorted(value):
            v = value[k]
            if self.follows(prefix + k, v):
                ids = ",".join(f'"#{e.id if e else merkle(x)}"' for x, e in self.elements(v, own.parts.get(k)))
                out.append(f"{_text(k)}:[{ids}]")
            else:
                out.append(f"{_text(k)}:{canonical(v)}")
        return "{" + ",".join(out) + "}"

    def rows(self, value: dict, own: Subtree, prefix: str = "", parent_pos: int = -1, place: str = "") -> Iterator[tuple]:
        """(branch, parent_pos, pos, place, parent_id, node_id, element, subtree) below an object."""
        for field, inner in value.items():
            branch = prefix + field
            if not self.follows(branch, inner):
                continue
            for pos, (child, subtree) in enumerate(self.elements(inner, own.parts.get(field))):
                here = f"{place}/{field}:{pos}"
                if self.wanted is None or branch in self.wanted:
                    yield branch, parent_pos, pos, here, own.id, subtree.id if subtree else merkle(child), child, subtree
                if isinstance(child, dict):
                    yield from self.rows(child, subtree, branch + "[].", pos, here)


_KINDS = {dict: "object", list: "array", str: "string", int: "number", float: "number", bool: "boolean", type(None): "null"}


def shred(df: DataFrame, record_id: str, payload: str, branches: tuple[str, ...] | None = PROFILE_BRANCHES) -> DataFrame:
    """One row for each element of each of `branches` in each record; of every array and object where `branches` is None.

    Columns: `record_id`, `branch`, `parent_pos` (−1 below the root), `pos`, `place` (the path of
    positions from the root), `parent_id` and `node_id` (Merkle identities), and `node_kind` (object,
    array, string, number, boolean, null) and `body` (canonical JSON, in which elements with rows of their
    own stand as their identities). Kind and body are there only where the node is met for the first time
    in an Arrow batch: an object is written once a batch, and once at all by `nodes`.

    Null, blank, truncated and non-object payloads give no rows; a null record id stays null.
    Records are independent, so nothing is shuffled. Other columns of `df` are not read.
    """
    walk = Walk(branches)
    names = [x.split()[0] for x in _SHRED_SCHEMA.split(", ")]
    types = [pa.int32() if x.endswith(" int") else pa.string() for x in _SHRED_SCHEMA.split(", ")]

    def batch_rows(batch: pa.RecordBatch) -> list[tuple]:
        rows, seen = [], set()
        for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            profile = read_profile(text)
            if profile is None:
                continue
            for branch, parent_pos, pos, place, parent_id, node, child, own in walk.rows(profile, Subtree(profile)):
                if node in seen:
                    rows.append((rid, branch, parent_pos, pos, place, parent_id, node, None, None))
                else:
                    seen.add(node)
                    rows.append((rid, branch, parent_pos, pos, place, parent_id, node, _KINDS[type(child)], walk.body(child, own, branch + "[].")))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), DEPTH))
        for batch in batches:
            rows = batch_rows(batch)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return df.select(F.col(record_id).cast("string"), F.col(payload)).mapInArrow(run, _SHRED_SCHEMA)


def nodes(shredded: DataFrame) -> DataFrame:
    """Each distinct element once: `node_id`, `node_kind`, `body`."""
    return shredded.where("body is not null").groupBy("node_id").agg(F.first("node_kind").alias("node_kind"), F.first("body").alias("body"))


def links(shredded: DataFrame) -> DataFrame:
    """Every occurrence, by identities, places and ordinals only."""
    return shredded.drop("node_kind", "body")


def latest(df: DataFrame, key: str, at: str, payload: str) -> DataFrame:
    """The row of each `key` with the latest `at` (a null `at` is the oldest; ties by the greater payload)."""
    return df.groupBy(key).agg(F.max_by(payload, F.struct(F.col(at), F.col(payload))).alias(payload))


def profile_children(candidates: DataFrame) -> DataFrame:
    """Child rows of each candidate's latest profile: strategies, triggers, roles and highlights.

    The label of a strategy is its `label`, or itself where it is a bare string; it is looked up in
    the table of nodes, and triggers take the label of the strategy they belong to. Roles and
    highlights have an empty label.
    """
    newest = latest(candidates, "candidate_id", "updated_at", "payload")
    label = F.when(F.col("node_kind") == "string", F.get_json_object(F.concat(F.lit('{"v":'), "body", F.lit("}")), "$.v")).otherwise(
        F.get_json_object("body", "$.label")
    )
    # of a node only its label is asked for here; identities travel as bytes
    rows = shred(newest, "candidate_id", "payload").select(
        "record_id", "branch", "parent_pos", "pos", F.unhex("node_id").alias("node"), F.unhex("parent_id").alias("parent"),
        F.col("body").isNotNull().alias("stored"), F.when(F.col("branch") == "strategies", label).alias("own"),
    )
    shredded = materialise(rows, "shredded")
    # a table of its own, so that a node met very often is a skewed join AQE can split
    once = materialise(shredded.where("stored").groupBy("node").agg(F.max("own").alias("own")), "nodes")
    child = F.element_at(
        F.create_map(*[F.lit(x) for pair in zip(PROFILE_BRANCHES, ("strategy", "trigger", "role", "highlight")) for x in pair]),
        F.col("branch"),
    )
    # a trigger is read through the strategy it belongs to, all others through themselves
    read = F.when(F.col("branch") == "strategies[].triggers", F.col("parent")).otherwise(F.col("node"))
    found = shredded.select("record_id", "branch", "parent_pos", "pos", read.alias("node")).join(once, "node")
    return found.select(
        F.col("record_id").alias("candidate_id"),
        child.alias("child"),
        "parent_pos",
        "pos",
        F.when(F.col("branch").startswith("strategies"), F.coalesce("own", F.lit(""))).otherwise(F.lit("")).alias("label"),
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_children(load(spark, sf_dir, "candidates"))


def p6_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct element of the latest profiles' branches once, with the identities of its children in it."""
    newest = latest(load(spark, sf_dir, "candidates"), "candidate_id", "updated_at", "payload")
    return nodes(shred(newest, "candidate_id", "payload"))
