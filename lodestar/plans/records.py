"""Queries over stores, logs, exports, imports and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import profiles as P
from ..operators import store as S
from ..sources import files as FI
from ..sources import records as R
from ..streaming.intake import event_windows as windows
from ..tables import load
from .registry import Registry
from .views import ALL, PROFILES, ROLES

registry = Registry()


def _events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


@registry.query(f"WITH {PROFILES} SELECT candidate_id, source_file, completeness, updated_at FROM profiles")
def upsert_latest(spark, sf):
    """The log of upserts folded to its last writers, rows replaced whole."""
    c = load(spark, sf, "candidates")
    old, new = c.where("updated_at < timestamp'2025-07-01'"), c.where("updated_at >= timestamp'2025-07-01' or updated_at is null")
    fold = lambda df: S.latest_by(df, "candidate_id", "updated_at", "payload")
    return S.upsert(fold(old), fold(new), "candidate_id").select("candidate_id", "source_file", "completeness", "updated_at")


@registry.query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts, max(event_id) FILTER (ts = m) AS event_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY 1")
def audit_latest(spark, sf):
    """The last entry of each user's log."""
    return S.latest_by(_events(spark, sf).select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_type", "ts", "event_id")


@registry.query(
    "WITH e AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, n, "
    + ", ".join(f"v[CAST(round((n - 1) * {s}) AS INT) + 1] AS p{round(s * 100)}" for s in (0.5, 0.95, 0.99)) + " FROM e"
)
def latency_percentiles(spark, sf):
    return E.nearest_rank(_events(spark, sf), "event_type", "value", [0.5, 0.95, 0.99])


@registry.query("SELECT date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 2) AS total, round(sum(value) / 1000000 * 3.5, 4) AS cost, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'error') > 0 AS alarm FROM events GROUP BY 1")
def stage_rollup(spark, sf):
    """Counts, totals, a cost by price a million and failures of each day of a trace; any failure raises the alarm."""
    failed = F.count_if(F.col("event_type") == "error")
    return _events(spark, sf).groupBy(F.date_trunc("day", "ts").alias("day")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.sum("value") / 1000000 * 3.5, 4).alias("cost"), F.countDistinct("user_id").alias("users"), failed.alias("failures"), (failed > 0).alias("alarm")
    )


@registry.query(
    """WITH l AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    SELECT user_id, event_id, ts, event_type, CAST(row_number() OVER (ORDER BY ts DESC, event_id DESC) AS INT) AS place FROM l WHERE rn = 1 AND event_type <> 'error'"""
)
def saved_list(spark, sf):
    """What is saved under each name, newest first; a name whose last entry deletes is gone."""
    log = _events(spark, sf).select("user_id", "event_id", "ts", "event_type")
    return S.saved(log, "user_id", "ts", "event_id", F.col("event_type") == "error")


@registry.query(
    f"SELECT doc_id, list_filter([CASE WHEN page_count > {FI.MAX_PAGES} THEN 'pages' END, CASE WHEN strlen(coalesce(text, '')) > {FI.MAX_BYTES} THEN 'bytes' END, CASE WHEN coalesce(file_type, '') NOT IN ('pdf', 'docx') THEN 'kind' END, CASE WHEN coalesce(trim(text), '') = '' THEN 'no text' END], lambda x: x IS NOT NULL) AS problems FROM documents"
)
def staging_limits(spark, sf):
    """What speaks against taking each document in: pages, bytes, kind, no text."""
    d = load(spark, sf, "documents")
    why = [
        F.when(F.col("page_count") > FI.MAX_PAGES, "pages"), F.when(F.octet_length(F.coalesce("text", F.lit(""))) > FI.MAX_BYTES, "bytes"),
        F.when(~F.coalesce("file_type", F.lit("")).isin("pdf", "docx"), "kind"), F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "no text"),
    ]
    return d.select("doc_id", F.array_compact(F.array(*why)).alias("problems"))


@registry.query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    """The streaming roll-up over the whole table as a batch."""
    return windows(_events(spark, sf))


@registry.query(
    f"""{ALL}, {ROLES}, sk AS (SELECT candidate_id, string_agg(skill, '; ' ORDER BY skill) AS skills FROM (SELECT DISTINCT candidate_id, skill FROM skills) GROUP BY 1),
    st AS (SELECT candidate_id, string_agg(strategy, '; ' ORDER BY strategy) AS strategies FROM strategies GROUP BY 1), n AS (SELECT candidate_id, count(*) AS n_roles FROM roles GROUP BY 1)
    SELECT candidate_id, region, country, seniority_level, CASE WHEN years_experience IS NULL THEN 'missing' ELSE 'known' END AS years_status, years_experience, coalesce(skills, '') AS skills, coalesce(strategies, '') AS strategies, coalesce(n_roles, 0) AS n_roles
    FROM profiles LEFT JOIN sk USING (candidate_id) LEFT JOIN st USING (candidate_id) LEFT JOIN n USING (candidate_id)"""
)
def flat_export(spark, sf):
    """One flat row a candidate without any personal column: values with their status, lists joined."""
    joined = lambda df, c, name: df.groupBy("candidate_id").agg(F.array_join(F.array_sort(F.collect_set(c)), "; ").alias(name))
    p = P.profiles(spark, sf, "region", "country", "seniority_level", "years_experience").join(joined(P.skills(spark, sf), "skill", "skills"), "candidate_id", "left").join(joined(P.strategies(spark, sf), "strategy", "strategies"), "candidate_id", "left")
    p = p.join(P.roles(spark, sf).groupBy("candidate_id").agg(F.count("*").alias("n_roles")), "candidate_id", "left")
    return p.select(
        "candidate_id", "region", "country", "seniority_level", F.when(F.col("years_experience").isNull(), "missing").otherwise("known").alias("years_status"), "years_experience",
        F.coalesce("skills", F.lit("")).alias("skills"), F.coalesce("strategies", F.lit("")).alias("strategies"), F.coalesce("n_roles", F.lit(0)).alias("n_roles"),
    )


@registry.query(f"""WITH {ROLES} SELECT candidate_id, seq, employer_raw, employer_canonical, title, start, "end", start_status, end_status, duration_months, is_current FROM roles""")
def long_export(spark, sf):
    return P.roles(spark, sf).select("candidate_id", "seq", "employer_raw", "employer_canonical", "title", "start", "end", "start_status", "end_status", "duration_months", "is_current")


@registry.query(
    """WITH s AS (SELECT DISTINCT chunk_id, doc_id, char_start, char_end FROM chunks WHERE char_start IS NOT NULL)
    SELECT chunk_id, substr(text, greatest(char_start - 80, 0) + 1, least(260, char_end + 80 - greatest(char_start - 80, 0))) AS context FROM s JOIN documents USING (doc_id) WHERE text IS NOT NULL"""
)
def evidence_context(spark, sf):
    """Eighty characters on both sides of each piece of evidence."""
    s = load(spark, sf, "chunks").where("char_start is not null").select("chunk_id", "doc_id", "char_start", "char_end").distinct()
    both = s.join(load(spark, sf, "documents").where("text is not null").select("doc_id", "text"), "doc_id")
    begin = F.greatest(F.col("char_start") - 80, F.lit(0))
    return both.select("chunk_id", F.substring("text", begin + 1, F.least(F.lit(260), F.col("char_end") + 80 - begin)).alias("context"))


@registry.query(
    """SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS years, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'years is missing' END AS problem FROM events"""
)
def import_props(spark, sf):
    """A semi-structured column read as typed, with the rows that lack the value flagged."""
    k = F.get_json_object("props", "$.k")
    return _events(spark, sf).select("event_id", k.try_cast("double").alias("years"), F.when(k.isNull(), "years is missing").alias("problem"))


_IMPORT = [("Ada", "Analyst", "emea", "7", "SQL; Python", None), ("Bo", None, "apac", "many", "", "x"), (None, "Trader", None, "3.5", "a,b;c", None)]


@registry.query(
    """SELECT * FROM (VALUES ('Ada', 'Analyst', 'emea', 7.0::DOUBLE, ['SQL', 'Python'], NULL), ('Bo', NULL, 'apac', NULL, []::VARCHAR[], 'years is no number'), (NULL, 'Trader', NULL, 3.5, ['a', 'b', 'c'], 'no name'))
    t(name, headline, region, years, skills, problem)"""
)
def import_flat(spark, sf):
    df = spark.createDataFrame(_IMPORT, "`Candidate Name` string, Title string, Location string, years string, Skills string, notes string")
    return R.import_flat(df).select("name", "headline", "region", "years", "skills", "problem")


@registry.query(
    """WITH s AS (SELECT doc_id, arg_min(raw_text, (saved_at, state_id)) AS kept FROM run_states WHERE raw_text IS NOT NULL AND raw_text <> '' GROUP BY 1)
    SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN kept ELSE text END IS NOT NULL AS has_text, coalesce(text, '') = '' AND kept IS NOT NULL AS reattached, md5(CASE WHEN coalesce(text, '') = '' THEN kept ELSE text END) AS digest FROM documents LEFT JOIN s USING (doc_id)"""
)
def raw_text_reattach(spark, sf):
    """Texts kept by a run put back where a document has none; the first saved wins."""
    kept = load(spark, sf, "run_states").where("raw_text <> ''").groupBy("doc_id").agg(F.min_by("raw_text", F.struct("saved_at", "state_id")).alias("kept"))
    none = F.coalesce("text", F.lit("")) == ""
    return load(spark, sf, "documents").join(kept, "doc_id", "left").select("doc_id", F.when(none, F.col("kept")).otherwise(F.col("text")).isNotNull().alias("has_text"), (none & F.col("kept").isNotNull()).alias("reattached"), F.md5(F.when(none, F.col("kept")).otherwise(F.col("text"))).alias("digest"))


_GRID = {"region": ["emea", "apac", "latam"], "approach": ["quant", "hybrid"]}


def _drawn(name: str) -> str:
    values = ", ".join(f"'{v}'" for v in _GRID[name])
    return f"[{values}][CAST(('0x' || substr(md5('7|{name}|' || id), 1, 8)) AS BIGINT) % {len(_GRID[name])} + 1] AS {name}"


@registry.query(f"SELECT substr(sha256('7|' || id), 1, 16) AS candidate_id, {', '.join(map(_drawn, _GRID))} FROM range(500) t(id)")
def synthetic_pool(spark, sf):
    return R.synthetic_pool(spark, 500, 7, _GRID)
