"""Queries that read entries out of documents, build chunks, resolve and merge values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import profiles as P
from ..tables import load
from . import requests as R
from .registry import Registry
from .texts import q
from .views import ALL, PROFILES, ROLES

registry = Registry()

_LINES = """l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, regexp_replace(unnest(ls), '\\r$', '') AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM l)"""
_HEAD = f"regexp_matches(line, {q(X.HEADER)}) AND NOT regexp_matches(line, {q(X.BULLET)})"


def _part(n: int) -> str:
    return f"nullif(trim(regexp_extract(line, {q(X.HEADER)}, {n})), '')"


@registry.query(
    f"""WITH {_LINES}, m AS (SELECT *, {_HEAD} AS head, sum(CASE WHEN {_HEAD} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS entry FROM p),
    h AS (SELECT doc_id, entry, {_part(1)} AS title, {_part(2)} AS employer, {_part(3)} AS location, {_part(4)} AS start, {_part(5)} AS "end" FROM m WHERE head),
    b AS (SELECT doc_id, entry, least(5, count(*)) AS n FROM m WHERE NOT head AND entry > 0 AND length(trim(line)) > 45 GROUP BY 1, 2)
    SELECT h.*, coalesce(n, 0) AS n_highlights FROM h LEFT JOIN b USING (doc_id, entry)"""
)
def role_entries(spark, sf):
    r = X.role_entries(load(spark, sf, "documents"), "doc_id", "text")
    return r.withColumn("n_highlights", F.size("highlights")).drop("highlights")


@registry.query(
    f"""WITH {_LINES}, e AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, nullif(regexp_extract(lower(line), {q(X.DEGREE)}, 1), '') AS degree, nullif(regexp_extract(lower(line), {q(X.INSTITUTION)}, 1), '') AS institution,
        try_cast(regexp_extract_all(line, '\\b(?:19|20)[0-9]{{2}}\\b')[-1] AS INT) AS year FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM l) WHERE NOT regexp_matches(line, {q(X.BULLET)}) AND length(line) <= 120)
    SELECT * FROM e WHERE degree IS NOT NULL AND institution IS NOT NULL"""
)
def education_lines(spark, sf):
    return X.education_lines(load(spark, sf, "documents"), "doc_id", "text")


@registry.query()
def strict_skill_hits(spark, sf):
    """Places of words that are skills only near a word of skill lists; look-around is beyond the SQL engine's patterns."""
    d, out = load(spark, sf, "documents"), None
    for label, word in (("r_lang", "R"), ("wind_db", "Wind")):
        n = X.near_hits(d, "doc_id", "text", word, "skill|programming|tool|python|habilidades|compétences|competenze|fähigkeiten", 90)
        part = d.select("doc_id", F.lit(label).alias("label"), n.alias("hits")).where("hits > 0")
        out = part if out is None else out.unionByName(part)
    return out


@registry.query(
    f"""WITH {ROLES}, c AS (SELECT candidate_id, seq, trim(coalesce(title, '') || ' — ' || coalesce(employer_canonical, employer_raw, ''), ' —') AS label,
        trim(regexp_replace(concat_ws(' ', title, employer_raw, location), '[ \\t\\n\\f\\r]+', ' ', 'g')) AS body FROM roles), k AS (SELECT * FROM c WHERE length(body) >= 12)
    SELECT candidate_id || ':role:' || (row_number() OVER (PARTITION BY candidate_id ORDER BY seq) - 1) AS chunk_id, label, substr(body, 1, 900) AS body FROM k"""
)
def chunks_built(spark, sf):
    """One chunk a role: texts under 12 characters are left out before numbering, none is longer than 900."""
    label = F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(" — "), F.coalesce("employer_canonical", "employer_raw", F.lit(""))))
    body = F.trim(F.regexp_replace(F.concat_ws(" ", "title", "employer_raw", "location"), r"[ \t\n\f\r]+", " "))
    edge = F.regexp_replace(F.regexp_replace(label, "^[ —]+", ""), "[ —]+$", "")
    c = P.roles(spark, sf).select("candidate_id", "seq", edge.alias("label"), body.alias("body")).where(F.length("body") >= 12)
    n = F.row_number().over(Window.partitionBy("candidate_id").orderBy("seq")) - 1
    return c.select(F.concat("candidate_id", F.lit(":role:"), n).alias("chunk_id"), "label", F.substring("body", 1, 900).alias("body"))


_ASKED = ["Yewdal Pinnace Consultng", "CASTELLAN PINNACE BANK", "Nothing Like It At All"]


@registry.query(
    f"""WITH a AS (SELECT unnest([{', '.join(map(q, _ASKED))}]) AS asked), s AS (SELECT asked, employer_canonical, round(1 - levenshtein(lower(asked), lower(employer_canonical)) / greatest(length(asked), length(employer_canonical), 1), 4) AS likeness FROM a, (SELECT DISTINCT employer_canonical FROM employers))
    SELECT asked, employer_canonical, likeness FROM s WHERE likeness >= 0.6 QUALIFY row_number() OVER (PARTITION BY asked ORDER BY likeness DESC, employer_canonical) = 1"""
)
def name_resolution(spark, sf):
    return X.closest(load(spark, sf, "employers"), "employer_canonical", _ASKED, 0.6)


@registry.query(
    f"""{ALL}, a AS (SELECT candidate_id, lower(skill) AS skill, max(depth) AS depth FROM skills GROUP BY 1, 2),
    b AS (SELECT DISTINCT candidate_id, lower(trim(regexp_replace(unnest(string_split(regexp_replace(text, '\\(.*?\\)', '', 'g'), ',')), '[.;]+$', ''))) AS skill FROM chunks WHERE kind = 'skills' AND text IS NOT NULL), bb AS (SELECT * FROM b WHERE skill <> '')
    SELECT candidate_id, skill, coalesce(depth, CASE WHEN bb.skill IS NOT NULL THEN 'mentioned' END) AS depth, CASE WHEN a.skill IS NOT NULL AND bb.skill IS NOT NULL THEN 'both' WHEN a.skill IS NOT NULL THEN 'first' ELSE 'second' END AS source
    FROM a FULL JOIN bb USING (candidate_id, skill)"""
)
def skill_union(spark, sf):
    """Skills of the profiles and of the skill chunks; the profile's depth goes first."""
    a = P.skills(spark, sf).select("candidate_id", F.lower("skill").alias("skill"), "depth")
    items = F.split(F.regexp_replace("text", r"\(.*?\)", ""), ",")
    b = load(spark, sf, "chunks").where("kind = 'skills' and text is not null").select("candidate_id", F.explode(items).alias("x"))
    b = b.select("candidate_id", F.lower(F.trim(F.regexp_replace("x", "[.;]+$", ""))).alias("skill"), F.lit("mentioned").alias("depth")).where("skill <> ''")
    return X.prefer_first(a, b, ["candidate_id", "skill"], "depth")


_OVER = ["region", "country", "seniority_level"]


@registry.query(
    f"""WITH {PROFILES}, k AS (SELECT candidate_id, {', '.join(f"arg_max({c}, updated_at) FILTER ({c} IS NOT NULL) AS n_{c}" for c in _OVER)} FROM candidates GROUP BY 1)
    SELECT candidate_id, {', '.join(f"coalesce(n_{c}, {c}) AS {c}" for c in _OVER)} FROM profiles JOIN k USING (candidate_id)"""
)
def corrections_overlay(spark, sf):
    """The latest rows with the last known value of each facet laid over them."""
    base = P.profiles(spark, sf, *_OVER)
    return X.overlay(base, load(spark, sf, "candidates"), "candidate_id", _OVER, "updated_at")


_REQUESTS = [
    "Must have 3–7 years and SQL. Python preferred; no event calendar.", "Ideally quant, with pandas. Required: EMEA.", "At least 3.5 years is essential. Must not be apac",
]
_VOCABULARY = {"skills": {"SQL": ["sql"], "Python": ["python"], "pandas": ["pandas"]}, "strategies": {"event_calendar": ["event calendar"]}, "regions": {"emea": ["emea", "europe"], "apac": ["apac", "asia"]}, "approaches": {"quant": ["quant"]}}


@registry.query(
    """SELECT * FROM (VALUES (0, 'SQL', 'Python', 'event_calendar', 3.0::DOUBLE, 7.0::DOUBLE), (1, 'emea', 'pandas; quant', '', NULL, NULL), (2, '', '', 'apac', 3.5, NULL)) t(n, must, prefer, exclude, min_years, max_years)"""
)
def request_parse(spark, sf):
    """Requests read into requirements, preferences and exclusions, clause by clause."""
    flat = lambda d: "; ".join(sorted(x for v in d.values() for x in v))
    rows = []
    for n, text in enumerate(_REQUESTS):
        r = R.parse(text, _VOCABULARY)
        rows.append((n, flat(r.must), flat(r.prefer), flat(r.exclude), r.min_years, r.max_years))
    return spark.createDataFrame(rows, "n int, must string, prefer string, exclude string, min_years double, max_years double")


@registry.query("WITH p AS (SELECT candidate_id, updated_at, payload, trim(payload) AS b FROM candidates WHERE payload IS NOT NULL) SELECT DISTINCT candidate_id, updated_at, json_valid(b) AS readable FROM p")
def payload_readable(spark, sf):
    """Which payloads hold JSON that can be read at all."""
    p = load(spark, sf, "candidates").where("payload is not null")
    return p.select("candidate_id", "updated_at", F.try_parse_json(F.trim("payload")).isNotNull().alias("readable")).distinct()
