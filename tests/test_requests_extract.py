from pyspark.sql import functions as F

from lodestar.operators import extract as X
from lodestar.operators.gating import Request
from lodestar.plans import requests as R

VOCABULARY = {"skills": {"SQL": ["sql"], "Python": ["python"], "C++": ["c++"]}, "sectors": {"healthcare": ["healthcare"], "financials": ["banks"]}, "certs": {"cfa": ["cfa"]}}


def test_requirement_by_clause():
    r = R.parse("Must have 3-7 years in healthcare. CFA preferred; no banks", VOCABULARY)
    assert r.must == {"sectors": ["healthcare"]} and r.prefer == {"certs": ["cfa"]} and r.exclude == {"sectors": ["financials"]} and (r.min_years, r.max_years) == (3, 7)
    assert R.parse("SQL, 5+ years", VOCABULARY) == Request(prefer={"skills": ["SQL"]})
    assert R.parse("Required: C++ and 3.5 years", VOCABULARY).min_years == 3.5
    assert R.parse("Minimum 4–8 years of SQL", VOCABULARY).max_years == 8
    assert R.parse("mysqld pythonic", VOCABULARY) == Request() == R.parse("", VOCABULARY)


def test_edits_and_templates():
    r = R.moved(Request(must={"skills": ["SQL"]}), "skills", "SQL", "prefer")
    assert r.must == {} and r.prefer == {"skills": ["SQL"]}
    assert R.moved(r, "skills", "SQL", "must") == Request(must={"skills": ["SQL"]})
    assert R.restored("{broken") == R.restored(None) == R.restored("[1]") == Request()
    assert R.restored('{"must": {"skills": ["a"]}, "min_years": 2, "prefer": 3}') == Request(must={"skills": ["a"]}, min_years=2.0)
    assert R.match_expression('sell-side "kdb+" a (x) risk') == '"sell-side" OR "kdb+" OR "risk"'


def test_tolerant_json(spark):
    cases = {"```json\n{\"a\": 1}\n```": '{"a": 1}', 'text {"a": 2} more': '{"a": 2}', "x [1, 2] y": "[1, 2]", "none": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.j for r in df.select("v", R.tolerant_json(F.col("v")).alias("j")).collect()} == cases


def test_role_entries(spark):
    text = "Experience\nAnalyst — Yewdale Pinnace, Porto (2019-01 – present)\n• Led a long and careful study of many banks in the north.\nshort\nTrader — Northgale Foundry (2016 – 2018)\r\nEducation"
    df = spark.createDataFrame([(1, text, "t"), (2, None, "t"), (3, "", "t")], "id int, text string, title string")
    got = {r.entry: r for r in X.role_entries(df, "id", "text").collect()}
    assert (got[1].title, got[1].employer, got[1].location, got[1].start, got[1].end) == ("Analyst", "Yewdale Pinnace", "Porto", "2019-01", "present")
    assert got[1].highlights == ["Led a long and careful study of many banks in the north."] and got[2].employer == "Northgale Foundry" and got[2].highlights == []
    assert X.role_entries(df.limit(0), "id", "text").count() == 0


def test_strict_hits(spark):
    df = spark.createDataFrame([("Skills: Python, R, SQL",), ("R. Smith wrote to us",), ("R&D",), (None,)], "t string")
    assert [r[0] for r in df.select(X.near_hits(df, "t", "t", "R", "skill|python", 90)).collect()] == [1, 0, 0, None]


def test_overlay_and_union(spark):
    base = spark.createDataFrame([("a", "old", 1), ("b", "keep", 2)], "id string, v string, n int")
    fixes = spark.createDataFrame([("a", "new", 3, 1), ("a", None, 4, 2), ("c", "x", 5, 1)], "id string, v string, n int, at int")
    assert {tuple(r) for r in X.overlay(base, fixes, "id", ["v"], "at").collect()} == {("a", "new", 1), ("b", "keep", 2)}
    a, b = spark.createDataFrame([("k", None), ("m", "1")], "k string, v string"), spark.createDataFrame([("k", "2"), ("z", "3")], "k string, v string")
    assert {tuple(r) for r in X.prefer_first(a, b, ["k"], "v").collect()} == {("k", "2", "both"), ("m", "1", "first"), ("z", "3", "second")}


def test_dated_entries(spark):
    from lodestar.plans.people import ORG_WORDS, TITLE_WORDS

    text = """Northgale Bank
Senior Analyst | 2019-01 – present
• led a study from 2018 to 2019
Yewdale Pinnace Group, Porto (Sept.2016 – 2018)
Junior Analyst
Castellan Bank
2014 – 2015
Portfolio Manager — Larkhill Capital, Lyon (09/2010 - 12/2013)
nothing dated here"""
    df = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x")], "id int, t string, title string")
    got = [(r.entry, r.title, r.employer, r.start, r.end) for r in X.dated_entries(df, "id", "t", TITLE_WORDS, ORG_WORDS).orderBy("entry").collect()]
    assert got == [
        (1, "Senior Analyst", "Northgale Bank", "2019-01", "present"), (2, "Junior Analyst", "Yewdale Pinnace Group", "Sept.2016", "2018"),
        (3, None, "Castellan Bank", "2014", "2015"), (4, "Portfolio Manager", "Larkhill Capital", "09/2010", "12/2013"),
    ]
    assert X.dated_entries(df.limit(0), "id", "t", TITLE_WORDS, ORG_WORDS).count() == 0
