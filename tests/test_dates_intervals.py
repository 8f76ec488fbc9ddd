import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions.dates import month_index, month_label, parse_date, parse_duration
from lodestar.operators.intervals import employment_periods, merge_intervals, periods_and_gaps


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [("May'22", "2022-05"), ("Oct-'20", "2020-10"), ("Mayr'23", "2023-05"), ("Sept.2021", "2021-09"), ("09/2019", "2019-09"), ("till date", "present"), ("Since May 2022", "2022-05"),
     ("2016", "2016"), ("garbage", None), ("unknown", None), ("", None), (None, None), ("PRESENT", "present"), ("Jun’19", "2019-06"), ("99", None), ("x" * 100_000, None)],
)
def test_dates(spark, text, want):
    assert one(spark, parse_date, text) == want


@pytest.mark.parametrize("text, want", [("8 years 10 months", 106), ("2 months", 2), ("none", None), (None, None), ("1.5 years", 18)])
def test_durations(spark, text, want):
    assert one(spark, parse_duration, text) == want


def test_december_stays_in_its_year(spark):
    assert one(spark, lambda c: month_label(month_index(c, "2025-12")), "2020-12") == "2020-12"
    assert one(spark, lambda c: month_label(month_index(c, "2025-12")), "present") == "2025-12"


def brute(rows):
    by = {}
    for k, s, e in rows:
        if s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    out = set()
    for k, spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(k, "period", s, e) for s, e in merged}
        out |= {(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def test_periods_same_as_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "c", "d", None]), rng.choice([None, *range(40)]), rng.choice([None, *range(40)])) for _ in range(300)]
    rows += [("hot", i % 50, i % 50 + 2) for i in range(2000)] + [("touch", 1, 2), ("touch", 2, 3), ("gap", 1, 2), ("gap", 3, 4)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "key string, a int, b int, s string, island int")
    got = periods_and_gaps(df, "key", "a", "b")
    assert {(r.key, r.kind, r.a, r.b) for r in got.collect()} == brute(rows)
    assert got.count() == len(brute(rows))
    assert merge_intervals(df.limit(0), "key", "a", "b").count() == 0


def test_employment(spark):
    rows = [
        ("u", "2019-01", "2022-01", False), ("u", "2020-01", "2021-01", False), ("g", "2013-06", "2015-03", False), ("g", "2017-04", "2019-09", None), ("g", "2019-10", "2024-01", False),
        ("n", "2024-01", None, True), ("n", "2020-01", "", False), ("r", "2024-01", "2023-01", True), ("x", "??", "2020-01", None), ("y", "May'98", "present", False), ("z", "2020-01", "2021-01", True),
    ]
    df = spark.createDataFrame([(*r, "k") for r in rows], "candidate_id string, start string, end string, is_current boolean, kind string")
    got = {tuple(r) for r in employment_periods(df).collect()}
    assert got == {
        ("u", "period", "2019-01", "2022-01"), ("g", "period", "2013-06", "2015-03"), ("g", "gap", "2015-03", "2017-04"), ("g", "period", "2017-04", "2019-09"), ("g", "gap", "2019-09", "2019-10"),
        ("g", "period", "2019-10", "2024-01"), ("n", "period", "2024-01", "2025-12"), ("z", "period", "2020-01", "2021-01"),
    }


def test_months_as_the_statement_lists_them(spark):
    """The statement's forms, and spellings that are none of them."""
    from lodestar.functions.dates import read_month

    read = {
        "2019-04": (2019, 4), "2016": (2016, 6), "09/2019": (2019, 9), "9/2019": (2019, 9), "May'22": (2022, 5), "Oct-'20": (2020, 10), "Mayr'23": (2023, 5), "Sept.2021": (2021, 9), "Sept 2021": (2021, 9),
        "since May 2022": (2022, 5), "Since Sept.2021": (2021, 9), "june’99": (2099, 6), "DECEMBER 1999": (1999, 12), " 2016 ": (2016, 6), "PRESENT": (2025, 12), "Till  Date": (2025, 12), "current": (2025, 12),
    }
    unread = ["2001-13", "13/2001", "2003-5", "5.2003", "2009/03", "now", "ongoing", "today", "till now", "presently", "present role", "about 2016", "2016-2017", "garbage", "tbc", "??", "", "  ", None, "May", "'22", "1816", "marching 3", "8 years 10 months"]
    df = spark.createDataFrame([(x,) for x in [*read, *unread]], "t string")
    got = {r.t: r.m for r in df.select("t", read_month(F.col("t"), "2025-12").alias("m")).collect()}
    assert got == {**{k: y * 12 + m for k, (y, m) in read.items()}, **dict.fromkeys(unread)}
