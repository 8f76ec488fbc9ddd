"""Facts about people on small invented tables, which hold what the test data lack."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lodestar.functions import vocabulary as V
from lodestar.plans import match, people

CV = """Ada Brinkmoor, CFA
ada.brinkmoor@post.example | +44 7700 900123
London
Marital Status: Single
Passed CFA Level II in 2019; FRM. ISSN 1234-5678
Languages: English (native), French - conversational
Skills: C++, C#, Python, SQL, Java
Built a Python pipeline for time series of credit spreads in a very long and careful line.
Maintained Python code and SQL tables for the bond desk through many quarters of trading.
MBA, University of Norrby, GPA 3.8/4.0 (2015)"""


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("people"))
    at = dt.datetime(2025, 1, 1)
    texts = [(1, CV), (2, "CFA charterholder. Speaks Spanish."), (3, None), (4, ""), (5, "x" * 50_000), (1, CV)]
    documents = [(i, t, "en", "s", len(t or ""), "a" if i < 3 else "b", "f.pdf", at) for i, t in texts]
    spark.createDataFrame(documents, "doc_id bigint, text string, lang string, source string, n_chars bigint, candidate_id string, source_file string, ingested_at timestamp").write.parquet(f"{path}/documents.parquet")
    payload = lambda name, languages: json.dumps({"data": {"sensitive": {"full_name": {"value": name}}, "languages": languages, "employment": [{"employer_raw": {"value": "Norrby Bank", "confidence": 0.9, "validation_status": "verified"}, "title_raw": {"value": None}}]}})
    rows = [("a", payload("Ada B.", [{"language": "French", "proficiency": "fluent"}]), 9.0, at), ("b", "{broken", None, at), ("c", None, None, None)]
    spark.createDataFrame(rows, "candidate_id string, payload string, years_experience double, updated_at timestamp").withColumns({c: F.lit(None).cast(t) for c, t in {"source_file": "string", "region": "string", "country": "string", "seniority_level": "string", "approach": "string", "feeder_path": "string", "completeness": "double", "needs_review": "int", "is_synthetic": "int", "near_duplicate_of": "string"}.items()}).write.parquet(f"{path}/candidates.parquet")
    role = lambda c, seq, title, tier, start, end, place, intern=False: (c, seq, "Norrby Bank", "Norrby Bank", tier, title, 3, place, start, end, end == "present", intern, at, at)
    roles = [role("a", 1, "Junior Analyst", "mbb", "2020-01", "present", "Zürich"), role("a", 2, "Analyst", "pod_shop", "2016", "2019-12", "Paris"), role("b", 1, "Summer Intern", None, "2020-01", "2020-06", None, True)]
    spark.createDataFrame(roles, "candidate_id string, seq int, employer_raw string, employer_canonical string, employer_tier string, title string, seniority_level int, location string, start string, `end` string, is_current boolean, is_internship boolean, recorded_at timestamp, ingested_at timestamp").write.parquet(f"{path}/employment.parquet")
    return path


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_words_have_edges(spark):
    words = {"cpp": "c++", "csharp": "c#, .net", "java": "java", "q": "q language"}
    cases = {"C++/C#": {("cpp", 1), ("csharp", 1)}, "javascript c": set(), "Java, java;JAVA": {("java", 3)}, "net of costs, .NET": {("csharp", 1)}, "the q  language": {("q", 1)}, "": set(), None: None, "é java" * 3: {("java", 1)}}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: None if r.h is None else {(x.label, x.hits) for x in r.h} for r in df.select("t", V.word_hits(V.spaced(F.col("t")), words).alias("h")).collect()}
    assert {k: v or set() for k, v in got.items()} == {k: v or set() for k, v in cases.items()}


def test_certificates(spark, sf):
    assert rows(people.certification_hits(spark, sf), "doc_id", "certification", "status") == sorted([(1, "cfa", "level_ii"), (1, "frm", None), (2, "cfa", "charterholder")], key=str)
    assert rows(people.certifications_kept(spark, sf), "candidate_id", "certification", "status", "doc_id") == [("a", "cfa", "level_ii", 1), ("a", "frm", None, 1)]


def test_languages(spark, sf):
    assert rows(people.language_skills(spark, sf), "doc_id", "language", "proficiency") == sorted([(1, "english", "native"), (1, "french", "conversational"), (2, "spanish", None)] + [(1, "english", "native"), (1, "french", "conversational")], key=str)
    assert rows(people.language_union(spark, sf), "candidate_id", "language", "proficiency", "source") == [("a", "english", "native", "second"), ("a", "french", "fluent", "both"), ("a", "spanish", None, "second")]


def test_identity(spark, sf):
    (r,) = {tuple(x) for x in people.identity_facts(spark, sf).where("doc_id = 1").collect()}
    assert r == (1, "Ada Brinkmoor", "ada.brinkmoor@post.example", "+44 7700 900123", "Single", "United Kingdom")
    (m,) = people.identity_merged(spark, sf).where("candidate_id = 'a'").collect()
    assert (m.name, m.name_source, m.phone_source) == ("Ada B.", "model", None if m.phone is None else "rule")
    c = {x.doc_id: x for x in people.contact_facts(spark, sf).collect()}
    assert c[1].phones == ["+44 7700 900123"] and c[1].publications == 1 and c[1].years == ["2015", "2019"] and c[4].emails == [] and 3 not in c


def test_depth_and_profile(spark, sf):
    depth = {x.label: (x.hits, x.depth) for x in people.skill_depth_lines(spark, sf).where("candidate_id = 'a'").collect()}
    assert depth["python"][1] == "core" and depth["java"][1] == "mentioned" and depth["sql"][1] == "core"  # the document is there twice
    (p,) = people.quant_profile(spark, sf).where("candidate_id = 'a'").collect()
    assert p.quant >= 5 and p.label == "quantitative"


def test_place_seniority_way(spark, sf):
    (g,) = people.geography_vote(spark, sf).where("candidate_id = 'a'").collect()
    assert (g.country, g.region) == ("Switzerland", "emea") and 0.4 < g.confidence < 0.96
    (s,) = people.seniority_person(spark, sf).where("candidate_id = 'a'").collect()
    assert s.level == 3 and people.seniority_person(spark, sf).where("candidate_id = 'b'").count() == 0
    assert people.feeder_path(spark, sf).where("candidate_id = 'a'").count() == 1


def test_claims_and_gold(spark, sf):
    (c,) = match.claims_coverage(spark, sf).collect()
    assert (c.candidate_id, c.claims, c.abstained, c.checked) == ("a", 2, 1, 1)
    assert rows(match.gold_scores(spark, sf), "field", "verdict", "n") == [("employer", "match", 1), ("title", "abstained", 1)]


def test_education(spark, sf):
    got = [(r.doc_id, r.degree, r.institution, r.year, r.mark) for r in match.education_facts(spark, sf).collect()]
    assert got == [(1, "mba", "university", 2015, "3.8/4.0")] * len(got) and got


def test_empty_tables(spark, sf, tmp_path):
    for name in ("documents", "candidates", "employment"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for query in (people.certification_hits, people.language_union, people.geography_vote, people.identity_merged, people.feeder_path, people.seniority_person, people.quant_profile, people.skill_depth_lines, match.claims_coverage, match.claims_error, match.gold_scores, match.education_facts):
        found = query(spark, str(tmp_path)).collect()
        assert found == [] or query is match.claims_error
