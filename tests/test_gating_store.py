import io
import zipfile

from pyspark.sql import functions as F

from lodestar.operators import gating as G
from lodestar.operators import profiles as P
from lodestar.operators import scoring as S
from lodestar.operators import store
from lodestar.sources import files, records
from lodestar.streaming import intake

SCHEMA = "candidate_id string, skills array<string>, strategies array<string>, regions array<string>, approaches array<string>, years double, quality double"


def view(spark, *rows):
    return spark.createDataFrame([(f"c{i}", *r) for i, r in enumerate(rows)], SCHEMA)


def test_gate_is_three_valued(spark):
    v = view(spark, (["sql"], ["x"], ["emea"], [], 5.0, 1.0), (["go"], [], ["apac"], [], 2.0, 1.0), ([], [], [], [], None, 0.5), (["SQL"], ["bad"], ["emea"], [], 30.0, 1.0))
    r = G.Request(must={"skills": ["SQL"]}, prefer={"regions": ["latam"]}, exclude={"strategies": ["Bad"]}, min_years=3, max_years=20)
    got = {x.candidate_id: x for x in G.gate(v, r).collect()}
    assert [got[f"c{i}"].kept for i in range(4)] == [True, False, True, False]
    assert got["c1"].reasons == ["must-have skills: SQL (has go)", "years below 3"] and len(got["c2"].caveats) == 2
    assert got["c3"].reasons == ["excluded strategies: bad", "years above 20"]
    assert G.gate(v.limit(0), r).count() == 0


def test_experience_band(spark):
    v = view(spark, *[([], [], [], [], y, 1.0) for y in (5.0, 2.0, 9.0, None)])
    got = [round(r.c_experience, 4) for r in S.components(v, G.Request(min_years=3, max_years=7)).orderBy("candidate_id").collect()]
    assert got == [1.0, 0.6667, 0.9, 0.4]
    assert {r.c_skills for r in S.components(v, G.Request()).collect()} == {0.5}


def test_preference_never_eliminates(spark):
    v = view(spark, (["go"], [], [], [], None, 0.2))
    assert G.gate(v, G.Request(prefer={"skills": ["sql"]})).first().kept
    assert G.filter_rail(spark.createDataFrame([("a", None)], "id string, region string"), {"region": []}).count() == 1


def test_scorer_sees_no_protected_column():
    assert not set(P.SCORABLE) & set(P.PROTECTED)


def test_store(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, n int, t string")
    new = spark.createDataFrame([("b", 2, None), ("c", 2, "z")], "id string, n int, t string")
    assert {tuple(r) for r in store.upsert(old, new, "id").collect()} == {("a", 1, "x"), ("b", 2, None), ("c", 2, "z")}
    gone = old.where("id = 'a'")
    tables = {"one": old, "two": new, "three": spark.range(2).withColumnRenamed("id", "other")}
    assert store.residue(store.erase(tables, gone, "id"), gone, "id").count() == 0
    assert store.residue(tables, gone, "id").count() == 1
    asked = spark.createDataFrame([("m", "hello"), ("m", "new")], "model string, prompt string")
    cache = asked.limit(1).select(F.sha2(F.concat_ws("||", "model", "prompt"), 256).alias("cache_key"), F.lit("hi").alias("answer"))
    assert {(r.prompt, r.hit) for r in store.replay(asked, cache, ["model", "prompt"]).collect()} == {("hello", True), ("new", False)}


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx():
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t, m="": f"<w:tc><w:tcPr>{m}</w:tcPr>{p(t)}</w:tc>"
    body = p("First") + f"<w:tbl><w:tr>{cell('A')}{cell('B')}</w:tr><w:tr>{cell('gone', '<w:vMerge/>')}{cell('C')}</w:tr></w:tbl>" + p("Last")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {W}>{p('Head')}</w:hdr>")
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(docx())
    (tmp_path / "b.docx").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "c.pdf").write_bytes(b"plain")
    (tmp_path / "d.docx").write_bytes(b"PK\x03\x04 broken")
    (tmp_path / "e.txt").write_bytes(b"{\\rtf1 x}")
    found = files.files(spark, str(tmp_path))
    assert {r.path[-5:]: r.kind for r in found.collect()} == {"a.pdf": "zip", ".docx": "pdf", "c.pdf": "unknown", "e.txt": "rtf"} or {r.kind for r in found.collect()} == {"zip", "pdf", "unknown", "rtf"}
    got = {r.path[-6:]: r for r in files.docx_scan(found).collect()}
    assert got["/a.pdf"].text == "First\nA | B\nC\nLast" and got["/a.pdf"].header_footer == ["Head"] and got["d.docx"].problem.startswith("unreadable")


def test_reading_order(spark):
    schema = "doc string, page int, width double, height double, x0 double, y0 double, x1 double, y1 double, t string"
    block = lambda doc, x, y, t: (doc, 1, 600.0, 800.0, x, y, x + 200, y + 90, t)
    two = [block("d", x, y, f"{side}{i}") for i, y in enumerate((10.0, 200.0, 400.0)) for side, x in (("l", 50.0), ("r", 350.0))]
    # a centred name over one column, and two stray labels at its side
    one = [block("e", 260.0, 5.0, "name")] + [block("e", 50.0, y, f"b{i}") for i, y in enumerate((100.0, 300.0, 500.0))] + [block("e", 400.0, y, "label") for y in (100.0, 150.0)]
    got = files.reading_order(spark.createDataFrame(two + one, schema)).orderBy("doc", "place").collect()
    assert [r.t for r in got if r.doc == "d"] == ["l0", "l1", "l2", "r0", "r1", "r2"]
    assert {r.col for r in got if r.doc == "e"} == {0} and [r.t for r in got if r.doc == "e"][0] == "name"
    assert files.reading_order(spark.createDataFrame([], schema)).count() == 0


def test_records(spark, tmp_path):
    df = spark.createDataFrame([("Ann", "7", "a;b, c"), (None, "x", None)], "`Full Name` string, Years string, skills string")
    got = records.import_flat(df).collect()
    assert (got[0].name, got[0].years, got[0].skills, got[0].problem) == ("Ann", 7.0, ["a", "b", "c"], None) and got[1].problem == "no name"
    path = str(tmp_path / "out")
    records.export_csv(spark.createDataFrame([("a", ["x", "y"])], "id string, l array<string>"), path)
    assert records.flat_csv(spark, path, ["id", "l"]).first().l == "x; y"
    (tmp_path / "p.json").write_text('{"candidates": [{"candidate_id": "q", "n": 1}]}')
    assert records.profile_artefact(spark, str(tmp_path / "p.json")).first().candidate_id == "q"
    grid = {"a": ["x", "y"]}
    one, two = records.synthetic_pool(spark, 50, 3, grid), records.synthetic_pool(spark, 50, 3, grid).repartition(7)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    batch = spark.createDataFrame([(1, "The ﬁrst text. " * 30), (2, None)], "doc_id bigint, text string")
    batch.write.parquet(src)
    for _ in range(2):  # the second start finds nothing new
        intake.start_intake(intake.document_stream(spark, src, batch.schema), out, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 2 and got.where("contains(text, 'first')").count() == 1
