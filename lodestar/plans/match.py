"""Queries of matching as a whole: full ranking, search page, slate, pool, claims, gold scores, flat exports, merged roles."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.dates import let, month_index, parse_date
from ..operators import evaluate as E
from ..operators import extract as X
from ..operators import gating as G
from ..operators import profiles as P
from ..operators import scoring as S
from ..operators import search as SE
from ..operators import store as ST
from ..operators.intervals import AS_OF
from ..session import materialise, shared_dir
from ..sources import records as R
from ..tables import load
from . import careers, extraction, people, pool, records, search
from .registry import Registry
from .sql_found import _month
from .texts import q
from .views import ALL, PARSED, PROFILES, ROLES

registry = Registry()

# ------------------------------------------------------------------ ranking

#: The weights of the full score; `approaches` stands for the sector, which the tables lack.
FULL_WEIGHTS = {"skills": 0.30, "strategies": 0.20, "approaches": 0.15, "semantic": 0.15, "regions": 0.10, "experience": 0.05, "quality": 0.05}
_SEM = f"""{search._CHUNKS}, {search._bm25("SELECT chunk_id AS d, coalesce(text, '') AS t FROM c", 50)},
    sem AS (SELECT c.candidate_id, max(score) AS s FROM lexical JOIN c ON c.chunk_id = lexical.d WHERE query = 'q1' AND c.candidate_id IS NOT NULL GROUP BY 1),
    bounds AS (SELECT min(s) AS lo, max(s) AS hi, count(*) AS n FROM sem)"""
_SEMANTIC = "CASE WHEN bounds.n = 0 THEN 0.5 ELSE (coalesce(sem.s, lo) - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END END"
_PARTS = "[" + ", ".join(f"{{'name': '{k}', 'part': round({w} * c_{k}, 6)}}" for k, w in FULL_WEIGHTS.items()) + "]"


def _semantic(spark, sf):
    """(`candidate_id`, `s`): the score of the chunk of each candidate that is nearest to the first sample query."""
    c = search._chunks(spark, sf)
    hits = SE.bm25(c, "chunk_id", F.col("text"), search.QUERIES[:1], 50).join(c.select("chunk_id", "candidate_id"), "chunk_id")
    return hits.where("candidate_id is not null").groupBy("candidate_id").agg(F.max("score").alias("s"))


@registry.query(
    f"""{pool._VIEW}, {pool._gate_sql(pool.REQUEST)}, {_SEM}, comps AS ({pool._components_sql(pool.REQUEST)}, reasons, caveats FROM gated),
    full_ AS (SELECT comps.*, ({_SEMANTIC})::DOUBLE AS c_semantic FROM comps LEFT JOIN sem USING (candidate_id), bounds), parts AS (SELECT *, {_PARTS} AS parts FROM full_)
    SELECT candidate_id, len(reasons) = 0 AS kept, reasons, caveats, CASE WHEN len(reasons) = 0 THEN CAST(round(CAST(round({' + '.join(f'{w} * c_{k}' for k, w in FULL_WEIGHTS.items())}, 6) AS DECIMAL(9, 6)), 4) AS DOUBLE) END AS total,
        CASE WHEN len(reasons) = 0 THEN list_transform(list_sort(list_transform(parts, lambda x: {{'p': -x.part, 'n': x.name}}))[1:3], lambda x: x.n) END AS top_parts FROM parts"""
)
def ranked_full(spark, sf):
    """Every candidate with reasons and caveats; those kept with a total of seven components, the semantic one set between
    the least and the greatest score found, and with the three components that give most. Excluded ones have no total."""
    view = G.gate(G.scorable(spark, sf), pool.REQUEST)
    sem = _semantic(spark, sf)
    lo, hi, n = sem.agg(F.min("s"), F.max("s"), F.count("*")).first()  # three numbers
    c = S.components(view, pool.REQUEST).join(view.select("candidate_id", "reasons", "caveats", "kept"), "candidate_id").join(sem, "candidate_id", "left")
    semantic = F.lit(0.5) if not n else (F.coalesce("s", F.lit(lo)) - lo) / ((hi - lo) or 1.0)
    c = c.withColumn("c_semantic", semantic)
    parts = F.array(*[F.struct((-F.round(F.lit(w) * F.col(f"c_{k}"), 6)).alias("p"), F.lit(k).alias("n")) for k, w in FULL_WEIGHTS.items()])
    # six digits first, as decimals: what lies on the edge of a digit is then rounded alike everywhere
    total = F.round(F.round(sum((F.lit(w) * F.col(f"c_{k}") for k, w in FULL_WEIGHTS.items()), F.lit(0.0)), 6).cast("decimal(9,6)"), 4).cast("double")
    top = F.transform(F.slice(F.array_sort(parts), 1, 3), lambda x: x["n"])
    return c.select("candidate_id", "kept", "reasons", "caveats", F.when(F.col("kept"), total).alias("total"), F.when(F.col("kept"), top).alias("top_parts"))


@registry.query(
    f"""{pool._VIEW}, {pool._gate_sql(pool.REQUEST)}, {_SEM} SELECT g.candidate_id, coalesce(sem.s, 0)::DOUBLE AS score, sem.s IS NOT NULL AS hit FROM gated g JOIN profiles p USING (candidate_id) LEFT JOIN sem USING (candidate_id)
    WHERE len(reasons) = 0 AND p.region IN ('emea', 'apac', 'north_america')"""
)
def search_page(spark, sf):
    """Candidates that the filters and the gate allow: those a search hits with its score, then all others with 0."""
    allowed = G.filter_rail(P.profiles(spark, sf, "region"), {"region": ["emea", "apac", "north_america"]}).join(G.gate(G.scorable(spark, sf), pool.REQUEST).where("kept").select("candidate_id"), "candidate_id", "left_semi").select("candidate_id")
    sem = _semantic(spark, sf)
    hits = sem.join(allowed, "candidate_id", "left_semi").select("candidate_id", F.col("s").alias("score"), F.lit(True).alias("hit"))
    return hits.unionByName(allowed.join(sem, "candidate_id", "left_anti").select("candidate_id", F.lit(0.0).alias("score"), F.lit(False).alias("hit")))


@registry.query(f"WITH {PROFILES} SELECT candidate_id, completeness, CAST(row_number() OVER (ORDER BY completeness DESC NULLS LAST, candidate_id) AS INT) AS place FROM profiles QUALIFY place <= 50")
def browse_order(spark, sf):
    """What is shown where nothing is asked: the 50 most complete profiles."""
    best = P.profiles(spark, sf, "completeness").orderBy(F.col("completeness").desc_nulls_last(), "candidate_id").limit(50)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.col("completeness").desc_nulls_last(), "candidate_id")))


@registry.query(
    pool._SCORED + """, best AS (SELECT candidate_id, total FROM scored WHERE total >= 0.4 ORDER BY total DESC, candidate_id LIMIT 40)
    SELECT candidate_id, total FROM best WHERE candidate_id NOT IN (SELECT candidate_id FROM profiles WHERE near_duplicate_of IS NOT NULL)"""
)
def slate(spark, sf):
    """The 40 best of a total of 0.4 or more, without those already listed; these leave after the limit, as surveyed."""
    scored = S.score(G.gate(G.scorable(spark, sf), pool.REQUEST).where("kept"), pool.REQUEST, pool.WEIGHTS).where("total >= 0.4")
    best = scored.select("candidate_id", "total").orderBy(F.desc("total"), "candidate_id").limit(40)
    return best.join(P.profiles(spark, sf, "near_duplicate_of").where("near_duplicate_of is not null"), "candidate_id", "left_anti")


@registry.query(
    f"""WITH {PROFILES}, made AS ({records.registry.sql['synthetic_pool']}), u AS (SELECT candidate_id, CASE WHEN is_synthetic = 1 THEN 'synthetic' ELSE 'store' END AS origin, region FROM profiles UNION ALL SELECT candidate_id, 'made', region FROM made)
    SELECT * FROM u WHERE candidate_id NOT IN (SELECT candidate_id FROM profiles WHERE needs_review = 1 AND candidate_id IS NOT NULL)"""
)
def pool_union(spark, sf):
    """The pool: stored and synthetic profiles and made ones, without those hidden."""
    p = P.profiles(spark, sf, "is_synthetic", "region", "needs_review")
    stored = p.select("candidate_id", F.when(F.col("is_synthetic") == 1, "synthetic").otherwise("store").alias("origin"), "region")
    made = R.synthetic_pool(spark, 500, 7, records._GRID).select("candidate_id", F.lit("made").alias("origin"), "region")
    return stored.unionByName(made).join(p.where("needs_review = 1").select("candidate_id"), "candidate_id", "left_anti")


@registry.query(f"WITH {PROFILES} SELECT region, count(*) AS n, round(avg(completeness), 4) AS mean_completeness, count(*) FILTER (years_experience IS NULL) AS unknown_years, count(*) FILTER (near_duplicate_of IS NOT NULL) AS near_duplicates FROM profiles WHERE needs_review = 1 GROUP BY 1")
def review_summary(spark, sf):
    """What waits for review, by region."""
    p = P.profiles(spark, sf, "region", "completeness", "years_experience", "near_duplicate_of", "needs_review").where("needs_review = 1")
    return p.groupBy("region").agg(
        F.count("*").alias("n"), F.round(F.avg("completeness"), 4).alias("mean_completeness"), F.count_if(F.col("years_experience").isNull()).alias("unknown_years"), F.count_if(F.col("near_duplicate_of").isNotNull()).alias("near_duplicates")
    )


@registry.query(
    "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT text) FROM documents) AS texts, (SELECT sum(length(text)) FROM documents) AS chars, (SELECT count(DISTINCT candidate_id) FROM candidates) AS candidates, (SELECT count(*) FROM employment) AS roles, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM documents WHERE coalesce(trim(text), '') = '') AS failures"
)
def run_manifest(spark, sf):
    """What a run over the tables reads and leaves out, as one row."""
    d = load(spark, sf, "documents")
    texts = d.agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("failures"))
    parts = [
        d.where("text is not null").groupBy(F.sha2("text", 256)).agg(F.lit(1).alias("x")).agg(F.count("*").alias("texts")), load(spark, sf, "candidates").agg(F.countDistinct("candidate_id").alias("candidates")),
        load(spark, sf, "employment").agg(F.count("*").alias("roles")), load(spark, sf, "chunks").agg(F.count("*").alias("chunks")),
    ]
    for part in parts:  # each is one row
        texts = texts.join(F.broadcast(part), F.lit(True))
    return texts.select("documents", "texts", "chars", "candidates", "roles", "chunks", "failures")


# ------------------------------------------------------------------ claims

_CLAIMED = ("employer_raw", "title_raw")
_CLAIMS = f"""WITH {PROFILES}, {PARSED}, e AS (SELECT candidate_id, unnest(from_json(p -> '$.employment', '["JSON"]')) AS x FROM parsed WHERE json_type(p -> '$.employment') = 'ARRAY'),
    claims AS ({' UNION ALL '.join(f"SELECT candidate_id, '{f}' AS field, x ->> '$.{f}.value' AS value, CAST(x ->> '$.{f}.confidence' AS DOUBLE) AS confidence, x ->> '$.{f}.validation_status' AS status FROM e" for f in _CLAIMED)})"""


def _claims(spark, sf):
    """Every tracked value of the roles of the latest profiles."""
    text = F.get_json_object(P.profile_json(F.col("payload")), "$.employment")
    items = F.from_json(F.when(F.startswith(text, F.lit("[")), text), "array<string>")
    rows = P.profiles(spark, sf, "payload").select("candidate_id", F.explode(items).alias("x"))
    at = lambda f, k: F.get_json_object("x", f"$.{f}.{k}")
    each = F.array(*[F.struct(F.lit(f).alias("field"), at(f, "value").alias("value"), at(f, "confidence").cast("double").alias("confidence"), at(f, "validation_status").alias("status")) for f in _CLAIMED])
    return rows.select("candidate_id", F.explode(each).alias("c")).select("candidate_id", "c.*")


@registry.query(f"{_CLAIMS} SELECT candidate_id, count(*) AS claims, count(*) FILTER (value IS NULL) AS abstained, count(*) FILTER (status IS NOT NULL) AS checked, round(avg(confidence), 6) AS mean_confidence FROM claims GROUP BY 1")
def claims_coverage(spark, sf):
    return _claims(spark, sf).groupBy("candidate_id").agg(
        F.count("*").alias("claims"), F.count_if(F.col("value").isNull()).alias("abstained"), F.count_if(F.col("status").isNotNull()).alias("checked"), F.round(F.avg("confidence"), 6).alias("mean_confidence")
    )


_TRUE = "CAST(CASE WHEN status IN ('verified', 'human_corrected') THEN 1 ELSE 0 END AS DOUBLE)"
_BINNED = f"""{_CLAIMS}, x AS (SELECT confidence AS c, {_TRUE} AS y FROM claims WHERE confidence IS NOT NULL), lim AS (SELECT min(c) AS lo, CASE WHEN max(c) > min(c) THEN (max(c) - min(c)) / 5 ELSE 1 END AS w FROM x),
    b AS (SELECT CAST(least(4, floor((c - lo) / w)) AS INT) AS bin, count(*) AS n, avg(c) AS mc, avg(y) AS acc, sum(pow(c - y, 2)) AS sq FROM x, lim GROUP BY 1)"""


@registry.query(f"{_BINNED} SELECT bin, n, round(mc, 4) AS mean_confidence, round(acc, 4)::DOUBLE AS accuracy, round(sq / n, 4) AS brier FROM b")
def claims_calibration(spark, sf):
    """Stated confidences of claims against what was verified or corrected by hand, in five bins."""
    return E.calibration(_claims(spark, sf).withColumn("y", F.expr(_TRUE)).where("confidence is not null"), "confidence", "y")


@registry.query(f"{_BINNED} SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(acc - mc)) / sum(n), 4) AS ece, round(sum(sq) / sum(n), 4) AS brier FROM b")
def claims_error(spark, sf):
    """Expected calibration error and Brier score of the claims, over the same bins."""
    return E.expected_error(_claims(spark, sf).withColumn("y", F.expr(_TRUE)), "confidence", "y")


_NORMED = lambda c: f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"


@registry.query(
    f"""{_CLAIMS.replace('WITH ', f'WITH {ROLES}, ', 1)}, head AS (SELECT candidate_id, from_json(p -> '$.employment', '["JSON"]')[1] AS x FROM parsed WHERE json_type(p -> '$.employment') = 'ARRAY'),
    gold AS (SELECT candidate_id, coalesce(employer_canonical, employer_raw) AS employer, title FROM roles QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY seq) = 1),
    j AS (SELECT 'employer' AS field, {_NORMED('employer')} AS g, {_NORMED("x ->> '$.employer_raw.value'")} AS p FROM gold JOIN head USING (candidate_id) UNION ALL SELECT 'title', {_NORMED('title')}, {_NORMED("x ->> '$.title_raw.value'")} FROM gold JOIN head USING (candidate_id))
    SELECT field, CASE WHEN p = '' THEN 'abstained' WHEN g = '' THEN 'hallucination' WHEN contains(g, p) OR contains(p, g) THEN 'match' ELSE 'miss' END AS verdict, count(*) AS n FROM j GROUP BY 1, 2"""
)
def gold_scores(spark, sf):
    """The first role of each profile against the table of roles as gold: containment either way is a match, abstaining is
    counted apart, and a value where gold has none is made up."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    text = F.get_json_object(P.profile_json(F.col("payload")), "$.employment")
    first = F.get(F.from_json(F.when(F.startswith(text, F.lit("[")), text), "array<string>"), F.lit(0))
    head = P.profiles(spark, sf, "payload").where(F.startswith(text, F.lit("["))).select("candidate_id", F.get_json_object(first, "$.employer_raw.value").alias("pe"), F.get_json_object(first, "$.title_raw.value").alias("pt"))
    gold = P.roles(spark, sf).groupBy("candidate_id").agg(F.min_by(F.struct(F.coalesce("employer_canonical", "employer_raw").alias("ge"), F.col("title").alias("gt")), "seq").alias("r")).select("candidate_id", "r.*")
    j = gold.join(head, "candidate_id").select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), norm(F.col(g)).alias("g"), norm(F.col(p)).alias("p")) for n, g, p in (("employer", "ge", "pe"), ("title", "gt", "pt"))])).alias("x")).select("x.*")
    verdict = F.when(F.col("p") == "", "abstained").when(F.col("g") == "", "hallucination").when(F.contains("g", F.col("p")) | F.contains("p", F.col("g")), "match").otherwise("miss")
    return j.groupBy("field", verdict.alias("verdict")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ flat exports

_STATUS = lambda path: f"coalesce(p ->> '$.{path}.validation_status', CASE WHEN p ->> '$.{path}.value' IS NULL THEN 'missing' ELSE 'extracted' END)"
_KNOWN = "CASE WHEN {0} IS NULL THEN 'missing' ELSE 'known' END AS {0}_status"
_FLAT = f"""{ALL}, {ROLES}, cur AS (SELECT * FROM roles QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY coalesce(is_current AND NOT coalesce(is_internship, false), false) DESC, coalesce(is_current, false) DESC, s DESC NULLS LAST, seq) = 1),
    sk AS (SELECT candidate_id, string_agg(skill, '; ' ORDER BY skill) AS skills_all FROM (SELECT DISTINCT candidate_id, skill FROM skills) GROUP BY 1), sc AS (SELECT candidate_id, string_agg(skill, '; ' ORDER BY skill) AS skills_core FROM (SELECT DISTINCT candidate_id, skill FROM skills WHERE depth = 'core') GROUP BY 1),
    st AS (SELECT candidate_id, string_agg(strategy, '; ' ORDER BY strategy) AS strategies FROM strategies GROUP BY 1), n AS (SELECT candidate_id, count(*) AS n_roles FROM roles GROUP BY 1),
    gp AS (SELECT candidate_id, count(*) AS n_employment_gaps FROM ({careers.registry.sql['employment_gaps']}) GROUP BY 1), hd AS (SELECT candidate_id, highest AS highest_degree FROM ({people.registry.sql['highest_degree']})),
    ce AS (SELECT candidate_id, string_agg(certification || CASE WHEN status IS NULL THEN '' ELSE ' (' || status || ')' END, '; ' ORDER BY certification) AS certifications FROM ({people.registry.sql['certifications_kept']}) GROUP BY 1),
    la AS (SELECT candidate_id, string_agg(language || CASE WHEN proficiency IS NULL THEN '' ELSE ' (' || proficiency || ')' END, '; ' ORDER BY language) AS languages FROM ({people.registry.sql['language_union']}) GROUP BY 1),
    hl AS (SELECT candidate_id, p ->> '$.headline.value' AS headline, {_STATUS('headline')} AS headline_status, p ->> '$.sensitive.full_name.value' AS full_name, {_STATUS('sensitive.full_name')} AS full_name_status,
        p ->> '$.sensitive.email.value' AS email, {_STATUS('sensitive.email')} AS email_status, p ->> '$.sensitive.phone.value' AS phone, {_STATUS('sensitive.phone')} AS phone_status FROM parsed)"""
_FLAT_COLUMNS = f"""candidate_id, profiles.source_file, coalesce(is_synthetic, 0) = 1 AS is_synthetic, headline, coalesce(headline_status, 'missing') AS headline_status, cur.location, {_KNOWN.format('location').replace('location IS', 'cur.location IS')}, country, region,
    years_experience, {_KNOWN.format('years_experience')}, profiles.seniority_level, cur.employer_canonical AS current_employer, cur.employer_tier AS current_employer_tier, cur.title AS current_title,
    CASE WHEN cur.is_current AND cur.s IS NOT NULL THEN greatest(0, {careers._NOW} - cur.s) END AS current_tenure_months, approach, feeder_path, coalesce(strategies, '') AS strategies, coalesce(skills_core, '') AS skills_core, coalesce(skills_all, '') AS skills_all,
    coalesce(certifications, '') AS certifications, coalesce(languages, '') AS languages, coalesce(highest_degree, '') AS highest_degree, coalesce(n_roles, 0) AS n_roles, coalesce(n_employment_gaps, 0) AS n_employment_gaps, completeness, coalesce(needs_review, 0) = 1 AS needs_human_review, near_duplicate_of"""
_FLAT_FROM = "FROM profiles " + " ".join(f"LEFT JOIN {t} USING (candidate_id)" for t in ("cur", "sk", "sc", "st", "n", "gp", "hd", "ce", "la", "hl"))
#: Personal columns, which leave by the switch alone.
PERSONAL = ["full_name", "full_name_status", "email", "email_status", "phone", "phone_status"]


def _flat(spark, sf, personal: bool):
    """One row a candidate: values with their status, lists joined. The frame without personal columns never reads them."""
    joined = lambda df, c, name: df.groupBy("candidate_id").agg(F.array_join(F.array_sort(F.collect_set(c)), "; ").alias(name))
    skills = P.skills(spark, sf)
    roles = P.roles(spark, sf)
    cur = P.current_role(roles).select("candidate_id", "location", F.col("employer_canonical").alias("current_employer"), F.col("employer_tier").alias("current_employer_tier"), F.col("title").alias("current_title"),
        F.when(F.col("is_current") & F.col("s").isNotNull(), F.greatest(F.lit(0), F.lit(careers._NOW) - F.col("s"))).alias("current_tenure_months"))
    with_status = lambda c, s: F.concat(c, F.coalesce(F.concat(F.lit(" ("), s, F.lit(")")), F.lit("")))
    profile = P.profile_json(F.col("payload"))
    fields = {"headline": "headline", **({"full_name": "sensitive.full_name", "email": "sensitive.email", "phone": "sensitive.phone"} if personal else {})}
    status = lambda j, path: F.coalesce(F.get_json_object(j, f"$.{path}.validation_status"), F.when(F.get_json_object(j, f"$.{path}.value").isNull(), "missing").otherwise("extracted"))
    p = P.profiles(spark, sf).withColumn("j", profile)
    readable = F.try_parse_json("j").isNotNull() & F.startswith("j", F.lit("{"))
    p = p.select("*", *[F.get_json_object("j", f"$.{path}.value").alias(k) for k, path in fields.items()], *[F.when(readable, status(F.col("j"), path)).alias(f"{k}_status") for k, path in fields.items()])
    parts = [
        cur, joined(skills, "skill", "skills_all"), joined(skills.where("depth = 'core'"), "skill", "skills_core"), joined(P.strategies(spark, sf), "strategy", "strategies"),
        roles.groupBy("candidate_id").agg(F.count("*").alias("n_roles")), careers.employment_gaps(spark, sf).groupBy("candidate_id").agg(F.count("*").alias("n_employment_gaps")),
        people.highest_degree(spark, sf).select("candidate_id", F.col("highest").alias("highest_degree")),
        joined(people.certifications_kept(spark, sf).withColumn("c", with_status(F.col("certification"), F.col("status"))), "c", "certifications"),
        joined(people.language_union(spark, sf).withColumn("c", with_status(F.col("language"), F.col("proficiency"))), "c", "languages"),
    ]
    for part in parts:
        p = p.join(part, "candidate_id", "left")
    known = lambda c: F.when(F.col(c).isNull(), "missing").otherwise("known").alias(f"{c}_status")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return p.select(
        "candidate_id", "source_file", (F.coalesce("is_synthetic", F.lit(0)) == 1).alias("is_synthetic"), "headline", F.coalesce("headline_status", F.lit("missing")).alias("headline_status"), "location", known("location"), "country", "region",
        "years_experience", known("years_experience"), "seniority_level", "current_employer", "current_employer_tier", "current_title", "current_tenure_months", "approach", "feeder_path", text("strategies"), text("skills_core"), text("skills_all"),
        text("certifications"), text("languages"), text("highest_degree"), F.coalesce("n_roles", F.lit(0)).alias("n_roles"), F.coalesce("n_employment_gaps", F.lit(0)).alias("n_employment_gaps"), "completeness",
        (F.coalesce("needs_review", F.lit(0)) == 1).alias("needs_human_review"), "near_duplicate_of",
        *[F.coalesce(c, F.lit("missing")).alias(c) if c.endswith("_status") else F.col(c) for c in (PERSONAL if personal else [])],
    )


@registry.query(f"{_FLAT} SELECT {_FLAT_COLUMNS} {_FLAT_FROM}")
def flat_export_full(spark, sf):
    return _flat(spark, sf, personal=False)


@registry.query(f"{_FLAT} SELECT {_FLAT_COLUMNS}, {', '.join(f'coalesce({c}, {q('missing')}) AS {c}' if c.endswith('_status') else c for c in PERSONAL)} {_FLAT_FROM}")
def flat_export_personal(spark, sf):
    """The same with the personal columns."""
    return _flat(spark, sf, personal=True)


# ------------------------------------------------------------------ roles read from documents, chunks of all kinds

_ENTRIES = f"({extraction.registry.sql['role_entries']})"
_NAMES = f"""names AS (SELECT employer_id, employer_canonical, {V.spaced_sql('a')} AS a FROM (SELECT employer_id, employer_canonical, unnest(list_append(coalesce(aliases, []), employer_canonical)) AS a FROM employers)),
    once AS (SELECT a, min(employer_canonical) AS canonical FROM names GROUP BY 1)"""


@registry.query(
    f"""WITH e AS (SELECT doc_id, entry, title, employer, location, {_month('start')} AS s, {_month('"end"')} AS e, {V.spaced_sql('employer')} AS a, lower(trim(coalesce(title, ''))) AS t FROM {_ENTRIES} WHERE title IS NOT NULL OR employer IS NOT NULL), {_NAMES}
    SELECT doc_id, entry, title, coalesce(canonical, employer) AS employer, canonical IS NOT NULL AS known, s AS from_index, e AS to_index, CASE WHEN e > s THEN e - s END AS months,
        CASE WHEN regexp_matches(t, '{careers._INTERN}') THEN 1 ELSE greatest(3, {people._RAISED}) END AS level FROM e LEFT JOIN once USING (a)"""
)
def employment_merged(spark, sf):
    """Roles read from documents with employer, months and level; an entry without title and employer is dropped."""
    e = X.role_entries(load(spark, sf, "documents"), "doc_id", "text").where("title is not null or employer is not null")
    index = lambda text: let(parse_date(text, 100, 2099), lambda x: month_index(x, AS_OF))
    names = load(spark, sf, "employers").select("employer_canonical", F.explode(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("employer_canonical"))).alias("x"))
    once = names.select(V.spaced(F.col("x")).alias("a"), "employer_canonical").groupBy("a").agg(F.min("employer_canonical").alias("canonical"))
    t = F.lower(F.trim(F.coalesce("title", F.lit(""))))
    level = F.when(F.regexp_like(t, F.lit(careers._INTERN)), 1).otherwise(F.greatest(F.lit(3), *[F.when(F.regexp_like(t, F.lit(p)), n).otherwise(0) for p, n in careers.TITLE_LEVELS]))
    e = e.select("doc_id", "entry", "title", "employer", index(F.col("start")).alias("from_index"), index(F.col("end")).alias("to_index"), V.spaced(F.col("employer")).alias("a"), level.alias("level"))
    j = e.join(once, "a", "left")
    months = F.when(F.col("to_index") > F.col("from_index"), F.col("to_index") - F.col("from_index"))
    return j.select("doc_id", "entry", "title", F.coalesce("canonical", "employer").alias("employer"), F.col("canonical").isNotNull().alias("known"), "from_index", "to_index", months.alias("months"), "level")


_SQUEEZED = lambda c: f"trim(regexp_replace({c}, '[ \\t\\n\\f\\r]+', ' ', 'g'))"


@registry.query(
    f"""{ALL}, {ROLES}, parts AS (
    SELECT candidate_id, 'summary' AS kind, 0 AS seq, {_SQUEEZED("p ->> '$.headline.value'")} AS body FROM parsed
    UNION ALL SELECT candidate_id, 'role', seq, {_SQUEEZED("concat_ws(' ', title, employer_raw, location)")} FROM roles
    UNION ALL SELECT candidate_id, 'degree', line_no, {_SQUEEZED('line')} FROM (SELECT d.candidate_id, min(e.line_no) AS line_no, x.line AS line FROM ({extraction.registry.sql['education_lines']}) e JOIN documents d USING (doc_id),
        LATERAL (SELECT string_split(d.text, chr(10))[e.line_no + 1] AS line) x WHERE d.candidate_id IS NOT NULL GROUP BY 1, 3)
    UNION ALL SELECT candidate_id, 'skills', 0, 'Skills: ' || string_agg(skill, ', ' ORDER BY skill) FROM (SELECT DISTINCT candidate_id, skill FROM skills) GROUP BY 1
    UNION ALL SELECT candidate_id, 'labels', 0, 'Labels: ' || string_agg(strategy, ', ' ORDER BY strategy) FROM strategies GROUP BY 1), kept AS (SELECT * FROM parts WHERE length(body) >= 12)
    SELECT candidate_id, kind, CAST(row_number() OVER (PARTITION BY candidate_id, kind ORDER BY seq, body) - 1 AS INT) AS nth, substr(body, 1, 900) AS body, length(body) > 900 AS cut FROM kept"""
)
def chunks_all(spark, sf):
    """One chunk a headline, role, line of a degree, list of skills and set of labels; bodies under 12 characters are left out before numbering."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"[ \t\n\f\r]+", " "))
    body = lambda df, kind, seq, c: df.select("candidate_id", F.lit(kind).alias("kind"), seq.alias("seq"), c.alias("body"))
    d = load(spark, sf, "documents").where("candidate_id is not null")
    lines = X.education_lines(d, "doc_id", "text").join(d.select("doc_id", "candidate_id", "text"), "doc_id").select("candidate_id", "line_no", F.get(F.split("text", "\n"), F.col("line_no")).alias("line"))
    lines = lines.groupBy("candidate_id", "line").agg(F.min("line_no").alias("line_no"))
    listed = lambda df, c, head: df.groupBy("candidate_id").agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_set(c)), ", ")).alias("x"))
    headline = P.profiles(spark, sf, "payload").select("candidate_id", F.get_json_object(P.profile_json(F.col("payload")), "$.headline.value").alias("h"))
    parts = [
        body(headline, "summary", F.lit(0), squeeze(F.col("h"))), body(P.roles(spark, sf), "role", F.col("seq"), squeeze(F.concat_ws(" ", "title", "employer_raw", "location"))), body(lines, "degree", F.col("line_no"), squeeze(F.col("line"))),
        body(listed(P.skills(spark, sf), "skill", "Skills: "), "skills", F.lit(0), F.col("x")), body(listed(P.strategies(spark, sf), "strategy", "Labels: "), "labels", F.lit(0), F.col("x")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    nth = F.row_number().over(Window.partitionBy("candidate_id", "kind").orderBy("seq", "body")) - 1
    return out.where(F.length("body") >= 12).select("candidate_id", "kind", nth.alias("nth"), F.substring("body", 1, 900).alias("body"), (F.length("body") > 900).alias("cut"))


# ------------------------------------------------------------------ erasure and fairness, carried out

_ERASED = ("candidates", "employment", "chunks", "documents", "run_states")


@registry.query(
    "WITH gone AS (SELECT DISTINCT candidate_id FROM candidates WHERE region = 'apac') "
    + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS before, count(*) FILTER (coalesce(candidate_id NOT IN (SELECT candidate_id FROM gone), true)) AS after, CAST(0 AS BIGINT) AS left_over FROM {t}" for t in _ERASED)
)
def erasure_residue(spark, sf):
    """The candidates of one region erased from every table, the tables written and read back: rows before, after, and of those erased."""
    tables = {n: load(spark, sf, n) for n in _ERASED}
    ids = tables["candidates"].where("region = 'apac'").select("candidate_id").distinct()
    kept = {n: materialise(df, f"erased-{n}") for n, df in ST.erase(tables, ids, "candidate_id").items()}
    out = None
    for n in _ERASED:
        left = kept[n].join(ids, "candidate_id", "left_semi").agg(F.count("*").alias("left_over"))
        part = tables[n].agg(F.count("*").alias("before")).join(F.broadcast(kept[n].agg(F.count("*").alias("after"))), F.lit(True)).join(F.broadcast(left), F.lit(True)).select(F.lit(n).alias("name"), "before", "after", "left_over")
        out = part if out is None else out.unionByName(part)
    return out


@registry.query(pool._SCORED + " SELECT candidate_id, total FROM scored")
def fairness_name_swap(spark, sf):
    """Totals after every name in the payloads was replaced and the table written anew: they must be those of the true names."""
    view = load(spark, sf, "candidates")
    other = F.regexp_replace("payload", r'("full_name\\?"\s*:\s*\{\s*\\?"value\\?"\s*:\s*\\?")[^"\\]*', "$1Somebody Else")
    path = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}-tables/swap-{uuid.uuid4().hex[:12]}"
    view.withColumn("payload", other).write.parquet(f"{path}/candidates.parquet")
    scorable = G.scorable(spark, path)
    assert not set(scorable.columns) & set(P.PROTECTED)
    return S.score(G.gate(scorable, pool.REQUEST).where("kept"), pool.REQUEST, pool.WEIGHTS).select("candidate_id", "total")


# ------------------------------------------------------------------ what careers and documents say together

@registry.query(
    f"""WITH {ROLES}, g AS ({careers.registry.sql['employment_gaps']}), r AS (SELECT candidate_id, e, min(seq) AS seq FROM roles WHERE e > s AND NOT coalesce(is_internship, false) GROUP BY 1, 2)
    SELECT g.candidate_id, gap_from, gap_to, months, r.seq AS after_seq FROM g LEFT JOIN r ON r.candidate_id = g.candidate_id AND lpad(CAST((r.e - 1) // 12 AS VARCHAR), 4, '0') || '-' || lpad(CAST((r.e - 1) % 12 + 1 AS VARCHAR), 2, '0') = gap_from"""
)
def gap_roles(spark, sf):
    """Each gap with the role that reached its beginning; of several the least."""
    from ..functions.dates import month_label

    r = P.roles(spark, sf).where("e > s and not coalesce(is_internship, false)").groupBy("candidate_id", month_label(F.col("e")).alias("gap_from")).agg(F.min("seq").alias("after_seq"))
    return careers.employment_gaps(spark, sf).join(r, ["candidate_id", "gap_from"], "left").select("candidate_id", "gap_from", "gap_to", "months", "after_seq")


_DEGREED = f"""{ROLES}, {PROFILES}, ed AS (SELECT d.candidate_id, min(e.year) AS first_degree FROM ({extraction.registry.sql['education_lines']}) e JOIN documents d USING (doc_id) WHERE e.year IS NOT NULL AND d.candidate_id IS NOT NULL GROUP BY 1),
    fr AS (SELECT candidate_id, min(s) AS first_start FROM roles WHERE s IS NOT NULL GROUP BY 1), du AS (SELECT candidate_id, count(*) AS twice FROM ({careers.registry.sql['duplicate_entries']}) GROUP BY 1)"""


@registry.query(
    f"""WITH {_DEGREED}, f AS (SELECT profiles.candidate_id, coalesce(fr.first_start < (ed.first_degree - 1) * 12 + 1, false) AS early_role, coalesce(years_experience > 2025 - ed.first_degree + 2, false) AS long_experience, coalesce(du.twice, 0) AS twice
        FROM profiles LEFT JOIN ed USING (candidate_id) LEFT JOIN fr USING (candidate_id) LEFT JOIN du USING (candidate_id)) SELECT * FROM f WHERE early_role OR long_experience OR twice > 0"""
)
def contradictions_degree(spark, sf):
    """Careers at odds with the first degree a document names: a role more than a year before it, or more years than since then and two; and entries made twice."""
    d = load(spark, sf, "documents").where("candidate_id is not null")
    ed = X.education_lines(d, "doc_id", "text").where("year is not null").join(d.select("doc_id", "candidate_id"), "doc_id").groupBy("candidate_id").agg(F.min("year").alias("first_degree"))
    fr = P.roles(spark, sf).where("s is not null").groupBy("candidate_id").agg(F.min("s").alias("first_start"))
    du = careers.duplicate_entries(spark, sf).groupBy("candidate_id").agg(F.count("*").alias("twice"))
    p = P.profiles(spark, sf, "years_experience")
    for part in (ed, fr, du):
        p = p.join(part, "candidate_id", "left")
    no = F.lit(False)
    f = p.select(
        "candidate_id", F.coalesce(F.col("first_start") < (F.col("first_degree") - 1) * 12 + 1, no).alias("early_role"),
        F.coalesce(F.col("years_experience") > 2025 - F.col("first_degree") + 2, no).alias("long_experience"), F.coalesce("twice", F.lit(0)).alias("twice"),
    )
    return f.where("early_role or long_experience or twice > 0")


@registry.query(
    "WITH d AS (" + " UNION ALL ".join(f"SELECT '{dim}' AS dim, {c} AS value FROM ({people.registry.sql[name]})" for dim, c, name in (("degree", "highest", "highest_degree"), ("certification", "certification", "certifications_kept"), ("language", "language", "language_union"), ("feeder_path", "label", "feeder_path"), ("approach", "label", "quant_profile"), ("country", "country", "geography_vote")))
    + ") SELECT dim, value, count(*) AS n FROM d WHERE value IS NOT NULL GROUP BY 1, 2"
)
def facet_people(spark, sf):
    """How often each value of the dimensions read out of documents occurs."""
    parts = [("degree", "highest", people.highest_degree), ("certification", "certification", people.certifications_kept), ("language", "language", people.language_union), ("feeder_path", "label", people.feeder_path), ("approach", "label", people.quant_profile), ("country", "country", people.geography_vote)]
    out = None
    for dim, c, query in parts:
        part = query(spark, sf).select(F.lit(dim).alias("dim"), F.col(c).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out.where("value is not null").groupBy("dim", "value").agg(F.count("*").alias("n"))


#: How a mark is written on a line of education.
GPA = r"(?i)\b(?:c?gpa)\b[^0-9\n]{0,6}([0-9](?:\.[0-9]{1,2})?(?: ?/ ?[0-9]{1,2}(?:\.0)?)?)"
PERCENT = r"([0-9]{2}(?:\.[0-9]{1,2})? ?%)"


@registry.query(
    f"""WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
    e AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, nullif(regexp_extract(lower(line), {q(X.DEGREE)}, 1), '') AS degree, nullif(regexp_extract(lower(line), {q(X.INSTITUTION)}, 1), '') AS institution,
        try_cast(regexp_extract_all(line, '\\b(?:19|20)[0-9]{{2}}\\b')[-1] AS INT) AS year, coalesce(nullif(regexp_extract(line, {q(GPA)}, 1), ''), nullif(regexp_extract(line, {q(PERCENT)}, 1), '')) AS mark FROM l WHERE NOT regexp_matches(line, {q(X.BULLET)}) AND length(line) <= 120)
    SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INT) AS nth FROM e WHERE degree IS NOT NULL OR institution IS NOT NULL QUALIFY nth <= 10"""
)
def education_facts(spark, sf):
    """Lines that name a degree or an institution, with their last year and a mark; the first ten of a document, as surveyed."""
    from ..operators.texts import lines_with_offsets

    lines = lines_with_offsets(load(spark, sf, "documents"), "doc_id", "text").where(~F.regexp_like("line", F.lit(X.BULLET)) & (F.length("line") <= 120))
    got = lambda text, p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    years = F.regexp_extract_all("line", F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1))
    e = lines.select(
        "doc_id", "line_no", got(F.lower("line"), X.DEGREE).alias("degree"), got(F.lower("line"), X.INSTITUTION).alias("institution"), F.try_element_at(years, F.lit(-1)).cast("int").alias("year"),
        F.coalesce(got(F.col("line"), GPA), got(F.col("line"), PERCENT)).alias("mark"),
    ).where("degree is not null or institution is not null")
    return e.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))).where("nth <= 10")


@registry.query(f"{ALL} SELECT candidate_id, skill, depth FROM skills")
def long_export_skills(spark, sf):
    return P.skills(spark, sf)


@registry.query(f"SELECT d.candidate_id, e.doc_id, e.line_no, e.degree, e.institution, e.year FROM ({extraction.registry.sql['education_lines']}) e JOIN documents d USING (doc_id) WHERE d.candidate_id IS NOT NULL")
def long_export_education(spark, sf):
    d = load(spark, sf, "documents").where("candidate_id is not null")
    return X.education_lines(d, "doc_id", "text").join(d.select("doc_id", "candidate_id"), "doc_id").select("candidate_id", "doc_id", "line_no", "degree", "institution", "year")


# ------------------------------------------------------------------ the whole scorable view

#: The dimensions of the full view beside those of the plain one.
_MORE = ("countries", "seniorities", "feeders", "tiers", "employers", "certifications", "languages", "degrees")
FULL_REQUEST = G.Request(
    must={"regions": ["emea", "apac"], "degrees": ["masters", "phd", "bachelors"]}, prefer={"skills": ["Python"], "tiers": ["pod_shop"], "feeders": ["quant_lab"], "languages": ["french"]},
    exclude={"tiers": ["regional_broker"], "strategies": ["event_calendar"]}, min_years=2.0, max_years=25.0, min_level=4,
)
_ONE = lambda c: f"CASE WHEN {c} IS NULL THEN [] ELSE [{c}] END"
_FULL_VIEW = f"""{pool._VIEW.replace('v AS (', 'v0 AS (')}, {ROLES}, ro AS (SELECT candidate_id, list_sort(list(DISTINCT employer_tier) FILTER (employer_tier IS NOT NULL)) AS tiers, list_sort(list(DISTINCT employer_canonical) FILTER (employer_canonical IS NOT NULL)) AS employers FROM roles WHERE NOT coalesce(is_internship, false) GROUP BY 1),
    ce AS (SELECT candidate_id, list_sort(list(DISTINCT certification)) AS certifications FROM ({people.registry.sql['certifications_kept']}) GROUP BY 1), la AS (SELECT candidate_id, list_sort(list(DISTINCT language)) AS languages FROM ({people.registry.sql['language_union']}) GROUP BY 1),
    hd AS (SELECT candidate_id, [highest] AS degrees FROM ({people.registry.sql['highest_degree']})), sp AS (SELECT candidate_id, level FROM ({people.registry.sql['seniority_person']})),
    v AS (SELECT v0.*, {_ONE('p.country')} AS countries, {_ONE('p.seniority_level')} AS seniorities, {_ONE('p.feeder_path')} AS feeders, coalesce(tiers, []) AS tiers, coalesce(employers, []) AS employers, coalesce(certifications, []) AS certifications, coalesce(languages, []) AS languages, coalesce(degrees, []) AS degrees, CAST(level AS INT) AS level
        FROM v0 JOIN profiles p USING (candidate_id) LEFT JOIN ro USING (candidate_id) LEFT JOIN ce USING (candidate_id) LEFT JOIN la USING (candidate_id) LEFT JOIN hd USING (candidate_id) LEFT JOIN sp USING (candidate_id))"""


def _full_view(spark, sf):
    """All that a gate or scorer may see of a candidate: 16 columns, none of them protected; internships lend no employer."""
    one = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(c))
    listed = lambda df, c, name: df.groupBy("candidate_id").agg(F.array_sort(F.collect_set(c)).alias(name))
    p = P.profiles(spark, sf, "country", "seniority_level", "feeder_path").select("candidate_id", one("country").alias("countries"), one("seniority_level").alias("seniorities"), one("feeder_path").alias("feeders"))
    paid = P.roles(spark, sf).where("not coalesce(is_internship, false)")
    parts = [
        paid.groupBy("candidate_id").agg(F.array_sort(F.collect_set("employer_tier")).alias("tiers"), F.array_sort(F.collect_set("employer_canonical")).alias("employers")),
        listed(people.certifications_kept(spark, sf), "certification", "certifications"), listed(people.language_union(spark, sf), "language", "languages"),
        people.highest_degree(spark, sf).select("candidate_id", F.array("highest").alias("degrees")), people.seniority_person(spark, sf).select("candidate_id", "level"),
    ]
    view = G.scorable(spark, sf).join(p, "candidate_id")
    for part in parts:
        view = view.join(part, "candidate_id", "left")
    empty = F.array().cast("array<string>")
    return view.withColumns({c: F.coalesce(c, empty) for c in _MORE})


@registry.query(f"{_FULL_VIEW} SELECT candidate_id, skills, strategies, regions, approaches, years, quality, level, {', '.join(_MORE)} FROM v")
def scorable_view_full(spark, sf):
    return _full_view(spark, sf).select("candidate_id", "skills", "strategies", "regions", "approaches", "years", "quality", "level", *_MORE)


@registry.query(f"{_FULL_VIEW}, {pool._gate_sql(FULL_REQUEST)} SELECT candidate_id, len(reasons) = 0 AS kept, reasons, caveats FROM gated")
def gate_full(spark, sf):
    """The gate over dimensions of the whole view, with bounds of years and of the level."""
    return G.gate(_full_view(spark, sf), FULL_REQUEST).select("candidate_id", "kept", "reasons", "caveats")


# ------------------------------------------------------------------ roles under headers of any form

_T = lambda c: f"coalesce(regexp_matches({c}, {q(people.TITLE_WORDS)}), false)"
_F = lambda c: f"coalesce(regexp_matches({c}, {q(people.ORG_WORDS)}), false)"
_AROUND = "' ,|()–—-' || chr(9) || chr(13)"


@registry.query(
    f"""WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
    s AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, trim(line, ' ' || chr(9) || chr(13)) AS s, regexp_matches(line, {q(X.BULLET)}) AS bullet FROM l), d AS (SELECT *, NOT bullet AND length(s) <= 160 AND regexp_matches(s, {q(X.DATED)}) AS dated FROM s),
    c AS (SELECT *, CASE WHEN s = '' OR bullet THEN NULL WHEN dated OR length(s) > 90 THEN '' ELSE s END AS c FROM d),
    a AS (SELECT *, nullif(coalesce(lag(c, 1) OVER w, lag(c, 2) OVER w, lag(c, 3) OVER w), '') AS above, nullif(lead(c, 1) OVER w, '') AS below FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    h AS (SELECT *, trim(regexp_replace(s, {q(X.DATED)}, '', 'g'), {_AROUND}) AS rest FROM a WHERE dated),
    p AS (SELECT *, list_filter(list_transform(string_split_regex(coalesce(CASE WHEN rest <> '' THEN rest ELSE above END, ''), {q(X.PARTED)}), lambda x: trim(x, {_AROUND})), lambda x: x <> '') AS parts FROM h),
    o AS (SELECT *, parts[1] AS one, parts[2] AS two FROM p), f AS (SELECT *, ({_F('one')} AND NOT {_T('one')}) OR ({_T('two')} AND NOT {_T('one')}) AS turned, {_T('one')} AND NOT {_F('one')} AS lone FROM o)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INT) AS entry, line_no,
        CASE WHEN two IS NULL THEN CASE WHEN lone THEN one WHEN {_T('below')} THEN below END WHEN turned AND NOT {_T('two')} AND {_T('below')} THEN below WHEN turned THEN two ELSE one END AS title,
        CASE WHEN two IS NULL THEN CASE WHEN NOT lone THEN one WHEN rest <> '' THEN above END WHEN turned THEN one ELSE two END AS employer,
        regexp_extract(s, {q(X.DATED)}, 1) AS start, regexp_extract(s, {q(X.DATED)}, 2) AS "end" FROM f"""
)
def dated_entries(spark, sf):
    """Roles of whole documents by their dated lines, whatever form these have."""
    return X.dated_entries(load(spark, sf, "documents"), "doc_id", "text", people.TITLE_WORDS, people.ORG_WORDS)
