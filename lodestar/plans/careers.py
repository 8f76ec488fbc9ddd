"""Queries over roles: dates, intervals, overlaps, gaps, tenure, duplicates, contradictions, titles, employers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.dates import month_label, parse_date, parse_duration
from ..operators import profiles as P
from ..operators.intervals import AS_OF, merge_intervals
from ..tables import load
from .registry import Registry
from .sql_found import _label, _month
from .views import ROLES

registry = Registry()
_NOW = 2025 * 12 + 12


@registry.query(
    f"""WITH d AS (SELECT DISTINCT start AS raw FROM employment UNION SELECT DISTINCT "end" FROM employment)
    SELECT raw, {_month("raw")} AS month FROM d WHERE raw IS NOT NULL"""
)
def date_parse(spark, sf):
    e = load(spark, sf, "employment")
    d = e.select(F.col("start").alias("raw")).unionByName(e.select(F.col("end").alias("raw"))).where("raw is not null").distinct()
    from ..functions.dates import let, month_index

    return d.select("raw", let(parse_date(F.col("raw"), 100, 2099), lambda x: month_index(x, AS_OF)).alias("month"))


@registry.query(
    f"""WITH d AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS raw FROM documents WHERE text IS NOT NULL),
    x AS (SELECT raw, try_cast(regexp_extract(lower(raw), '([0-9]+(?:\\.[0-9]+)?)\\s*(?:year|yr)', 1) AS DOUBLE) AS y,
        try_cast(regexp_extract(lower(raw), '([0-9]+)\\s*(?:month|mo\\b)', 1) AS INT) AS m FROM d)
    SELECT md5(raw) AS line, CAST(round(coalesce(y, 0) * 12 + coalesce(m, 0)) AS INT) AS months FROM x WHERE y IS NOT NULL OR m IS NOT NULL"""
)
def duration_parse(spark, sf):
    """Durations that the lines of all documents state, in months."""
    d = load(spark, sf, "documents").where("text is not null").select(F.explode(F.split("text", "\n")).alias("raw")).distinct()
    return d.select(F.md5("raw").alias("line"), parse_duration(F.col("raw")).alias("months")).where("months is not null")


def _islands(where: str) -> str:
    return f"""WITH {ROLES}, usable AS (SELECT DISTINCT candidate_id, s, e FROM roles WHERE e > s AND {where}),
    reach AS (SELECT *, max(e) OVER (PARTITION BY candidate_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM usable),
    marked AS (SELECT *, sum(CASE WHEN c IS NULL OR s > c THEN 1 ELSE 0 END) OVER (PARTITION BY candidate_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM reach),
    periods AS (SELECT candidate_id, island, min(s) AS s, max(e) AS e FROM marked GROUP BY ALL)"""


def _months(rows):
    merged = merge_intervals(rows, "candidate_id", "s", "e")
    return merged.groupBy("candidate_id").agg(F.sum(F.col("e") - F.col("s")).alias("months"), F.count("*").alias("islands"))


_PAID = "NOT coalesce(is_internship, false)"


@registry.query(_islands(_PAID) + " SELECT candidate_id, sum(e - s) AS months, count(*) AS islands FROM periods GROUP BY 1")
def experience_union(spark, sf):
    """Union, not sum, of the dated roles without internships."""
    return _months(P.roles(spark, sf).where("not coalesce(is_internship, false)"))


_RELEVANT = f"{_PAID} AND (employer_tier IN ('pod_shop', 'quant_fund', 'hedge_fund_other', 'long_only') OR regexp_matches(lower(title), 'research|analyst|investment|portfolio|quant'))"


@registry.query(_islands(_RELEVANT) + " SELECT candidate_id, sum(e - s) AS months, count(*) AS islands FROM periods GROUP BY 1")
def experience_relevant(spark, sf):
    tier = F.col("employer_tier").isin("pod_shop", "quant_fund", "hedge_fund_other", "long_only")
    title = F.regexp_like(F.lower("title"), F.lit("research|analyst|investment|portfolio|quant"))
    return _months(P.roles(spark, sf).where("not coalesce(is_internship, false)").where(F.coalesce(tier, F.lit(False)) | F.coalesce(title, F.lit(False))))


@registry.query(
    f"""WITH {ROLES}, d AS (SELECT candidate_id, max(CASE WHEN e > s THEN 1 ELSE 0 END) AS dated, sum(duration_months) AS stated FROM roles WHERE {_PAID} GROUP BY 1),
    u AS ({_islands(_PAID)} SELECT candidate_id, sum(e - s) AS months FROM periods GROUP BY 1)
    SELECT d.candidate_id, CAST(coalesce(u.months, d.stated) AS BIGINT) AS months, (CASE WHEN u.months IS NOT NULL THEN 0.9 WHEN d.stated IS NOT NULL THEN 0.6 ELSE 0.0 END)::DOUBLE AS confidence
    FROM d LEFT JOIN u USING (candidate_id)"""
)
def experience_total(spark, sf):
    """The union of dated roles, else the sum of stated durations, else nothing, with what either is worth."""
    rows = P.roles(spark, sf).where("not coalesce(is_internship, false)")
    stated = rows.groupBy("candidate_id").agg(F.sum("duration_months").alias("stated"))
    both = stated.join(_months(rows).select("candidate_id", "months"), "candidate_id", "left")
    sure = F.when(F.col("months").isNotNull(), 0.9).when(F.col("stated").isNotNull(), 0.6).otherwise(0.0)
    return both.select("candidate_id", F.coalesce("months", "stated").alias("months"), sure.alias("confidence"))


@registry.query(
    _islands(_PAID) + f""", following AS (SELECT *, lead(s) OVER (PARTITION BY candidate_id ORDER BY s) AS n FROM periods)
    SELECT candidate_id, {_label("e")} AS gap_from, {_label("n")} AS gap_to, n - e AS months FROM following WHERE n - e >= 6"""
)
def employment_gaps(spark, sf):
    """Gaps of six months or more between the periods of paid roles."""
    merged = merge_intervals(P.roles(spark, sf).where("not coalesce(is_internship, false)"), "candidate_id", "s", "e")
    n = merged.withColumn("n", F.lead("s").over(Window.partitionBy("candidate_id").orderBy("s")))
    return n.where("n - e >= 6").select("candidate_id", month_label(F.col("e")).alias("gap_from"), month_label(F.col("n")).alias("gap_to"), (F.col("n") - F.col("e")).alias("months"))


@registry.query(
    f"""WITH {ROLES}, r AS (SELECT * FROM roles WHERE e > s AND {_PAID})
    SELECT a.candidate_id, a.seq AS seq_a, b.seq AS seq_b, least(a.e, b.e) - greatest(a.s, b.s) AS months FROM r a JOIN r b ON a.candidate_id = b.candidate_id AND a.seq < b.seq
    WHERE least(a.e, b.e) - greatest(a.s, b.s) > 1"""
)
def employment_overlaps(spark, sf):
    """Pairs of a candidate's paid roles that overlap by more than a month: a range join within the candidate."""
    r = P.roles(spark, sf).where("e > s and not coalesce(is_internship, false)").select("candidate_id", "seq", "s", "e")
    a, b = (r.select("candidate_id", *[F.col(c).alias(f"{c}_{x}") for c in ("seq", "s", "e")]) for x in "ab")
    months = F.least("e_a", "e_b") - F.greatest("s_a", "s_b")
    return a.join(b, "candidate_id").where("seq_a < seq_b and s_a < e_b and s_b < e_a").withColumn("months", months).where("months > 1").select("candidate_id", "seq_a", "seq_b", "months")


_CURRENT = f"""WITH {ROLES}, current AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY
    coalesce(is_current AND {_PAID}, false) DESC, coalesce(is_current, false) DESC, s DESC NULLS LAST, seq) AS rn FROM roles) WHERE rn = 1)"""


@registry.query(_CURRENT + " SELECT candidate_id, seq, title, employer_canonical FROM current")
def current_role(spark, sf):
    return P.current_role(P.roles(spark, sf)).select("candidate_id", "seq", "title", "employer_canonical")


@registry.query(_CURRENT + f" SELECT candidate_id, greatest(0, {_NOW} - s) AS months FROM current WHERE is_current AND s IS NOT NULL")
def current_tenure(spark, sf):
    c = P.current_role(P.roles(spark, sf)).where("is_current and s is not null")
    return c.select("candidate_id", F.greatest(F.lit(0), F.lit(_NOW) - F.col("s")).alias("months"))


@registry.query(
    f"""WITH {ROLES} SELECT candidate_id, seq, make_date(CAST((s - 1) // 12 AS BIGINT), CAST((s - 1) % 12 + 1 AS BIGINT), 1) AS day_from,
        last_day(make_date(CAST((e - 1) // 12 AS BIGINT), CAST((e - 1) % 12 + 1 AS BIGINT), 1)) AS day_to,
        row_number() OVER (PARTITION BY candidate_id ORDER BY coalesce(is_current, false) DESC, s DESC, seq) AS place FROM roles WHERE e >= s"""
)
def role_timeline(spark, sf):
    """Dated roles with their days, current first, then by start, latest first (by month, not only by year)."""
    day = lambda c: F.make_date(F.floor((F.col(c) - 1) / 12).cast("int"), ((F.col(c) - 1) % 12 + 1).cast("int"), F.lit(1))
    w = Window.partitionBy("candidate_id").orderBy(F.coalesce("is_current", F.lit(False)).desc(), F.col("s").desc(), "seq")
    return P.roles(spark, sf).where("e >= s").select("candidate_id", "seq", day("s").alias("day_from"), F.last_day(day("e")).alias("day_to"), F.row_number().over(w).alias("place"))


_KEY = "lower(coalesce(employer_raw, '')), lower(coalesce(title, '')), coalesce(start, '')"


@registry.query(
    f"""WITH {ROLES} SELECT candidate_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, {_KEY} ORDER BY seq) AS rn FROM roles
    WHERE coalesce(employer_raw, '') <> '' OR coalesce(title, '') <> '' OR coalesce(start, '') <> '') WHERE rn > 1"""
)
def duplicate_entries(spark, sf):
    key = [F.lower(F.coalesce("employer_raw", F.lit(""))), F.lower(F.coalesce("title", F.lit(""))), F.coalesce("start", F.lit(""))]
    some = F.concat(*key) != ""
    w = Window.partitionBy("candidate_id", *key).orderBy("seq")
    return P.roles(spark, sf).where(some).withColumn("r", F.row_number().over(w)).where("r > 1").select("candidate_id", "seq")


@registry.query(
    f"""WITH {ROLES}, f AS (SELECT candidate_id, max(CASE WHEN e < s THEN 1 ELSE 0 END) AS reversed_dates, max(CASE WHEN e - s > 45 * 12 THEN 1 ELSE 0 END) AS long_tenure,
        max(CASE WHEN s IS NULL AND start IS NOT NULL AND trim(start) <> '' THEN 1 ELSE 0 END) AS unreadable, max(CASE WHEN is_current AND e < {_NOW} THEN 1 ELSE 0 END) AS ended_current FROM roles GROUP BY 1)
    SELECT * FROM f WHERE reversed_dates + long_tenure + unreadable + ended_current > 0"""
)
def contradictions(spark, sf):
    flag = lambda c: F.max(F.when(c, 1).otherwise(0))
    r = P.roles(spark, sf).groupBy("candidate_id").agg(
        flag(F.col("e") < F.col("s")).alias("reversed_dates"),
        flag(F.col("e") - F.col("s") > 45 * 12).alias("long_tenure"),
        flag(F.col("s").isNull() & (F.trim("start") != "")).alias("unreadable"),
        flag(F.col("is_current") & (F.col("e") < _NOW)).alias("ended_current"),
    )
    return r.where("reversed_dates + long_tenure + unreadable + ended_current > 0")


#: Patterns of titles and the least level they stand for; level 1 ends the search.
TITLE_LEVELS = [
    (r"\b(junior|jr)\b", 2), (r"\b(associate)\b", 4), (r"\b(senior analyst|investment analyst|equity research analyst|research analyst)\b", 4),
    (r"\b(lead analyst|vice president|vp|principal|senior investment)\b", 5), (r"\b(portfolio manager|pm|director|md|investment professional)\b", 6), (r"\b(head of|chief|cio|partner|founder)\b", 7),
]
_INTERN = r"\b(intern|trainee|summer analyst|apprentice)\b"
_LOW_RIGOR = ["regional_broker"]


@registry.query(
    f"""WITH t AS (SELECT DISTINCT title, coalesce(employer_tier, 'unknown') AS tier, lower(trim(title)) AS n FROM employment WHERE title IS NOT NULL),
    l AS (SELECT *, CASE WHEN regexp_matches(n, '{_INTERN}') THEN 1 ELSE greatest(3, {', '.join(f"CASE WHEN regexp_matches(n, '{p}') THEN {k} ELSE 0 END" for p, k in TITLE_LEVELS)}) END AS level FROM t)
    SELECT title, tier, CASE WHEN tier IN ('regional_broker') AND level >= 4 THEN level - 1 ELSE level END AS level FROM l"""
)
def title_level(spark, sf):
    """Level 1 to 7 of a title; the scan starts at 3 and rules only raise it, but for interns."""
    t = load(spark, sf, "employment").where("title is not null").select("title", F.coalesce("employer_tier", F.lit("unknown")).alias("tier")).distinct()
    n = F.lower(F.trim("title"))
    raised = F.greatest(F.lit(3), *[F.when(F.regexp_like(n, F.lit(p)), k).otherwise(0) for p, k in TITLE_LEVELS])
    level = F.when(F.regexp_like(n, F.lit(_INTERN)), 1).otherwise(raised)
    return t.withColumn("level", level).withColumn("level", F.when(F.col("tier").isin(_LOW_RIGOR) & (F.col("level") >= 4), F.col("level") - 1).otherwise(F.col("level")))


@registry.query(
    """WITH r AS (SELECT DISTINCT employer_raw, ' ' || trim(regexp_replace(lower(employer_raw), '[^a-z0-9]+', ' ', 'g')) || ' ' AS n FROM employment WHERE employer_raw IS NOT NULL),
    v AS (SELECT employer_canonical AS display, ' ' || trim(regexp_replace(lower(a), '[^a-z0-9]+', ' ', 'g')) || ' ' AS a FROM (SELECT employer_canonical, unnest(list_append(coalesce(aliases, []), employer_canonical)) AS a FROM employers)),
    h AS (SELECT employer_raw, display, row_number() OVER (PARTITION BY employer_raw ORDER BY length(a) DESC, display) AS rn FROM r JOIN v ON contains(n, a))
    SELECT employer_raw, display FROM h WHERE rn = 1"""
)
def employer_canonical(spark, sf):
    """The longest name or alias that stands, in whole words, in a typed employer.

    Names are joined by their first word, so the typed side is exploded into words instead of being
    compared with every name.
    """
    norm = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))
    r = load(spark, sf, "employment").where("employer_raw is not null").select("employer_raw").distinct().withColumn("n", norm(F.col("employer_raw")))
    names = F.explode(F.concat(F.array("employer_canonical"), F.coalesce("aliases", F.array().cast("array<string>"))))
    v = load(spark, sf, "employers").select(F.col("employer_canonical").alias("display"), names.alias("a")).withColumn("a", norm(F.col("a"))).withColumn("w", F.get(F.split(F.trim("a"), " "), F.lit(0)))
    words = r.select("employer_raw", "n", F.explode(F.array_distinct(F.split(F.trim("n"), " "))).alias("w"))
    hits = words.join(v, "w").where(F.contains("n", F.col("a")))
    return hits.groupBy("employer_raw").agg(F.min_by("display", F.struct(-F.length("a"), "display")).alias("display"))
