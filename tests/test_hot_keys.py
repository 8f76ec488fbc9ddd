"""Joins on keys that may be hot: both sides must come straight from a shuffle, or AQE cannot split them."""

import pytest

from lodestar.operators import components
from lodestar.operators.texts import shingle_classes


@pytest.fixture
def sorted_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def sides(df):
    """What stands below the sort of each side of each sort-merge join."""
    lines = [x.lstrip(" :+-*(0123456789)").split(" ")[0].split("(")[0] for x in df._jdf.queryExecution().executedPlan().toString().splitlines()]
    below = [lines[i + 1] for i, x in enumerate(lines) if x == "Sort"]
    assert "SortMergeJoin" in lines
    return below


def test_star_steps(sorted_joins):
    edges = sorted_joins.createDataFrame([(0, i) for i in range(1, 50)] + [(7, 8)], "u bigint, v bigint")
    for step in (components._large_star, components._small_star):
        assert set(sides(step(edges))) == {"Exchange"}
    got = components.connected_components(edges, "u", "v").collect()
    assert {r.component for r in got} == {0} and len(got) == 50


def test_classes_of_texts(sorted_joins):
    df = sorted_joins.createDataFrame([(i, "one two three four five six") for i in range(40)], "id int, t string")
    assert "Exchange" in sides(shingle_classes(df, "id", "t"))
    assert {(r.class_id, r.copies) for r in shingle_classes(df, "id", "t").collect()} == {(0, 40)}
