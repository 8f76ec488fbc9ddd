"""Queries over the pool: facets, coverage, quality, filters, gating, scoring, what-ifs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import gating as G
from ..operators import insight as I
from ..operators import profiles as P
from ..operators import scoring as S
from ..session import materialise
from ..tables import load
from .registry import Registry
from .views import ALL, PROFILES, ROLES

registry = Registry()

_BAND = "CASE WHEN years_experience IS NULL THEN 'unknown' WHEN years_experience < 2 THEN '<2' WHEN years_experience < 5 THEN '2-5' WHEN years_experience < 8 THEN '5-8' WHEN years_experience < 12 THEN '8-12' ELSE '12+' END"
_FACETS = (
    f"{ALL}, {ROLES}, facets AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS dim, {c} AS value, candidate_id FROM profiles WHERE {c} IS NOT NULL" for c in ("region", "country", "seniority_level", "approach", "feeder_path"))
    + f""" UNION ALL SELECT 'experience_band', {_BAND}, candidate_id FROM profiles
    UNION ALL SELECT 'skill', skill, candidate_id FROM skills UNION ALL SELECT 'skill_deep', skill, candidate_id FROM skills WHERE depth IN ('core', 'applied')
    UNION ALL SELECT 'strategy', strategy, candidate_id FROM strategies
    UNION ALL SELECT 'employer', employer_canonical, candidate_id FROM roles WHERE employer_canonical IS NOT NULL
    UNION ALL SELECT 'employer_tier', employer_tier, candidate_id FROM roles WHERE employer_tier IS NOT NULL)"""
)


@registry.query(_FACETS + " SELECT dim, value, count(*) AS n FROM facets GROUP BY ALL")
def facet_distributions(spark, sf):
    return I.distributions(I.facets(spark, sf))


@registry.query(_FACETS + " SELECT dim, list_sort(list(DISTINCT value)) AS vals FROM facets WHERE dim <> 'employer' GROUP BY 1")
def facet_values(spark, sf):
    """Distinct sorted values of the closed dimensions; employers are open and have their own counts."""
    return I.facets(spark, sf).where("dim <> 'employer'").groupBy("dim").agg(F.array_sort(F.collect_set("value")).alias("vals"))


@registry.query(
    f"""{ALL}, deep AS (SELECT DISTINCT candidate_id, skill FROM skills WHERE depth IN ('core', 'applied')),
    t AS (SELECT a.skill AS a, b.skill AS b, count(*) AS n FROM deep a JOIN deep b ON a.candidate_id = b.candidate_id AND a.skill < b.skill GROUP BY ALL ORDER BY n DESC, a, b LIMIT 40)
    SELECT * FROM t WHERE n >= 2"""
)
def skill_cooccurrence(spark, sf):
    return I.co_occurrence(P.skills(spark, sf).where("depth in ('core', 'applied')").select("candidate_id", "skill").distinct(), "skill")


_VOCABULARY = [("region", x) for x in ("apac", "emea", "latam", "north_america", "africa", "unknown")] + [("strategy", x) for x in ("credit_carry", "macro_thematic", "equity_pairs", "stat_signals", "fx_carry", "vol_dispersion")]
_VALUES = ", ".join(f"('{d}', '{v}')" for d, v in _VOCABULARY)


@registry.query(
    f"""{_FACETS}, v(dim, value) AS (VALUES {_VALUES}), c AS (SELECT dim, value, count(*) AS n FROM facets GROUP BY ALL)
    SELECT dim, value, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'none' ELSE 'thin' END AS severity FROM v LEFT JOIN c USING (dim, value) WHERE coalesce(n, 0) <= 2"""
)
def coverage_gaps(spark, sf):
    return I.coverage_gaps(I.distributions(I.facets(spark, sf)), spark.createDataFrame(_VOCABULARY, "dim string, value string"))


@registry.query(
    f"""{ALL} SELECT coalesce(strategy, 'any') AS strategy, coalesce(region, 'unknown') AS region, coalesce(approach, 'any') AS approach, count(*) AS n
    FROM profiles LEFT JOIN strategies USING (candidate_id) GROUP BY ALL ORDER BY n DESC, strategy, region, approach LIMIT 12"""
)
def strongest_cells(spark, sf):
    p = P.profiles(spark, sf, "region", "approach").join(P.strategies(spark, sf), "candidate_id", "left")
    cell = [F.coalesce("strategy", F.lit("any")).alias("strategy"), F.coalesce("region", F.lit("unknown")).alias("region"), F.coalesce("approach", F.lit("any")).alias("approach")]
    return p.groupBy(*cell).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "strategy", "region", "approach").limit(12)


_REGIONS = ["apac", "emea", "latam", "north_america", "unknown"]


@registry.query(
    f"{ALL} SELECT strategy, " + ", ".join(f"count(*) FILTER (region = '{r}') AS {r}" for r in _REGIONS) + " FROM strategies JOIN profiles USING (candidate_id) GROUP BY 1"
)
def coverage_pivot(spark, sf):
    both = P.strategies(spark, sf).join(P.profiles(spark, sf, "region"), "candidate_id")
    return both.groupBy("strategy").pivot("region", _REGIONS).count().na.fill(0)


@registry.query(
    f"""WITH {PROFILES} SELECT count(*) AS candidates, round(avg(completeness), 3) AS mean_completeness, round(avg(years_experience), 3) AS mean_years,
    count(*) FILTER (years_experience IS NULL) AS unknown_years, sum(needs_review) AS needs_review, sum(is_synthetic) AS synthetic, count(*) FILTER (near_duplicate_of IS NOT NULL) AS near_duplicates FROM profiles"""
)
def pool_quality(spark, sf):
    return P.profiles(spark, sf, "completeness", "years_experience", "needs_review", "is_synthetic", "near_duplicate_of").agg(
        F.count("*").alias("candidates"), F.round(F.avg("completeness"), 3).alias("mean_completeness"), F.round(F.avg("years_experience"), 3).alias("mean_years"),
        F.count_if(F.col("years_experience").isNull()).alias("unknown_years"), F.sum("needs_review").alias("needs_review"), F.sum("is_synthetic").alias("synthetic"),
        F.count_if(F.col("near_duplicate_of").isNotNull()).alias("near_duplicates"),
    )


@registry.query(
    f"""{_FACETS}, c AS (SELECT dim, value, count(*) AS n FROM facets GROUP BY ALL)
    SELECT dim, value, n, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY dim ORDER BY n DESC, value) AS INT) AS place FROM c) WHERE place <= 8"""
)
def pool_summary(spark, sf):
    return I.top_values(I.distributions(I.facets(spark, sf)), 8)


@registry.query(
    f"""WITH {PROFILES}, y AS (SELECT candidate_id, region, years_experience AS y FROM profiles WHERE years_experience IS NOT NULL),
    m AS (SELECT region, list_sort(list(y))[count(*) // 2 + 1] AS med FROM y GROUP BY 1) SELECT candidate_id, round(y - med, 4) AS delta FROM y JOIN m ON y.region IS NOT DISTINCT FROM m.region"""
)
def median_delta(spark, sf):
    """Years over the upper median of the region: the element at half the length, by rank rather than by a collected list."""
    y = P.profiles(spark, sf, "region", "years_experience").where("years_experience is not null").select("candidate_id", "region", F.col("years_experience").alias("y"))
    counts = y.groupBy("region", "y").agg(F.count("*").alias("k"))
    w = Window.partitionBy("region")
    ranked = counts.withColumns({"upto": F.sum("k").over(w.orderBy("y")), "total": F.sum("k").over(w)})
    med = ranked.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("region").agg(F.min("y").alias("med"))
    return y.join(med, y["region"].eqNullSafe(med["region"])).select("candidate_id", F.round(F.col("y") - F.col("med"), 4).alias("delta"))


@registry.query(f"{ALL} SELECT skill, count(*) AS listed, count(*) FILTER (depth IN ('core', 'applied')) AS used, count(*) FILTER (depth = 'core') AS core FROM skills GROUP BY 1")
def skill_depth(spark, sf):
    return P.skills(spark, sf).groupBy("skill").agg(F.count("*").alias("listed"), F.count_if(F.col("depth").isin("core", "applied")).alias("used"), F.count_if(F.col("depth") == "core").alias("core"))


@registry.query(f"WITH {PROFILES} SELECT seniority_level AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM profiles GROUP BY 1")
def primary_label_share(spark, sf):
    c = P.profiles(spark, sf, "seniority_level").groupBy(F.col("seniority_level").alias("label")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over the counts, a row a label
    return c.select("label", "n", F.round(F.col("n") / total, 4).alias("share"))


@registry.query("SELECT count(*) AS n, sum(needs_review) AS needs_review, sum(is_synthetic) AS synthetic, count(DISTINCT candidate_id) AS distinct_ids FROM candidates")
def store_stats(spark, sf):
    return load(spark, sf, "candidates").agg(F.count("*").alias("n"), F.sum("needs_review").alias("needs_review"), F.sum("is_synthetic").alias("synthetic"), F.countDistinct("candidate_id").alias("distinct_ids"))


# ------------------------------------------------------------------ filters and gates

_RAIL = {"region": ["emea", "apac"], "approach": ["quant", "hybrid"]}


@registry.query(f"WITH {PROFILES} SELECT candidate_id FROM profiles WHERE region IN ('emea', 'apac') AND approach IN ('quant', 'hybrid') AND (years_experience BETWEEN 3 AND 12 OR years_experience IS NULL) AND completeness >= 0.3")
def filter_rail(spark, sf):
    return G.filter_rail(P.profiles(spark, sf, "region", "approach", "years_experience", "completeness"), _RAIL, years=(3, 12), include_unknown_years=True, min_completeness=0.3).select("candidate_id")


@registry.query(f"WITH {PROFILES} SELECT candidate_id FROM profiles WHERE contains(lower(region), 'merica') AND years_experience >= 5")
def list_candidates(spark, sf):
    """The listing's filter, in which unknown years fail, unlike in the gate."""
    return P.profiles(spark, sf, "region", "years_experience").where(F.contains(F.lower("region"), F.lit("merica")) & (F.col("years_experience") >= 5)).select("candidate_id")


@registry.query(f"WITH {PROFILES} SELECT candidate_id FROM profiles WHERE contains(lower(concat_ws(' ', source_file, region, country, seniority_level, approach, feeder_path)), 'sell_side')")
def text_row_search(spark, sf):
    joined = F.lower(F.concat_ws(" ", "source_file", "region", "country", "seniority_level", "approach", "feeder_path"))
    return P.profiles(spark, sf, "source_file", "region", "country", "seniority_level", "approach", "feeder_path").where(F.contains(joined, F.lit("sell_side"))).select("candidate_id")


#: The requisition of the sample queries.
REQUEST = G.Request(
    must={"skills": ["Python", "SQL", "VBA"], "regions": ["emea", "north_america"]},
    prefer={"skills": ["pandas", "Git"], "strategies": ["credit_carry", "stat_signals"], "approaches": ["quant"]},
    exclude={"strategies": ["event_calendar"]},
    min_years=3.0,
    max_years=20.0,
)



_VIEW = f"""{ALL}, sk AS (SELECT candidate_id, list_sort(list(DISTINCT skill)) AS skills FROM skills GROUP BY 1),
    st AS (SELECT candidate_id, list_sort(list(DISTINCT strategy)) AS strategies FROM strategies GROUP BY 1),
    v AS (SELECT p.candidate_id, coalesce(skills, []) AS skills, coalesce(strategies, []) AS strategies, CASE WHEN region IS NULL OR region = 'unknown' THEN [] ELSE [region] END AS regions,
        CASE WHEN approach IS NULL THEN [] ELSE [approach] END AS approaches, years_experience AS years, completeness AS quality FROM profiles p LEFT JOIN sk USING (candidate_id) LEFT JOIN st USING (candidate_id))"""


def _list(xs):
    return "[" + ", ".join(f"'{x.lower()}'" for x in xs) + "]"


def _any(column, xs):
    return f"list_has_any(list_transform({column}, lambda x: lower(x)), {_list(xs)})"


def _gate_sql(r: G.Request) -> str:
    reasons, caveats = [], []
    for k, xs in r.must.items():
        shown = ", ".join(xs)
        reasons.append(f"CASE WHEN len({k}) > 0 AND NOT {_any(k, xs)} THEN 'must-have {k}: {shown} (has ' || array_to_string({k}[1:4], ', ') || ')' END")
        caveats.append(f"CASE WHEN len({k}) = 0 THEN '{k} not stated, {shown} not confirmed' END")
    for k, xs in r.exclude.items():
        reasons.append(f"CASE WHEN {_any(k, xs)} THEN 'excluded {k}: ' || array_to_string(list_filter({k}, lambda x: list_contains({_list(xs)}, lower(x))), ', ') END")
    if r.min_years is not None:
        reasons.append(f"CASE WHEN years < {r.min_years} THEN 'years below {r.min_years:g}' END")
        caveats.append(f"CASE WHEN years IS NULL THEN 'years unknown, minimum {r.min_years:g} not confirmed' END")
    if r.max_years is not None:
        reasons.append(f"CASE WHEN years > {r.max_years} THEN 'years above {r.max_years:g}' END")
    if r.min_level is not None:
        reasons.append(f"CASE WHEN level < {r.min_level} THEN 'level ' || level || ' below {r.min_level}' END")
        caveats.append(f"CASE WHEN level IS NULL THEN 'level unknown, minimum {r.min_level} not confirmed' END")
    keep = lambda xs: f"list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL)"
    return f"gated AS (SELECT *, {keep(reasons)} AS reasons, {keep(caveats)} AS caveats FROM v)"


@registry.query(f"{_VIEW}, {_gate_sql(REQUEST)} SELECT candidate_id, len(reasons) = 0 AS kept, len(reasons) AS n_reasons, len(caveats) AS n_caveats FROM gated")
def gate_candidates(spark, sf):
    g = G.gate(G.scorable(spark, sf), REQUEST)
    return g.select("candidate_id", "kept", F.size("reasons").alias("n_reasons"), F.size("caveats").alias("n_caveats"))


@registry.query(f"{_VIEW}, {_gate_sql(REQUEST)} SELECT candidate_id, reasons, caveats FROM gated WHERE len(reasons) + len(caveats) > 0")
def gate_reasons(spark, sf):
    return G.gate(G.scorable(spark, sf), REQUEST).where("size(reasons) + size(caveats) > 0").select("candidate_id", "reasons", "caveats")


@registry.query(f"{_VIEW} SELECT candidate_id, skills, strategies, regions, approaches, years, quality FROM v")
def scorable_view(spark, sf):
    return G.scorable(spark, sf)


@registry.query(f"WITH {PROFILES} SELECT candidate_id, 'Candidate ' || upper(substr(candidate_id, 1, 8)) AS shown FROM profiles")
def blind_names(spark, sf):
    return load(spark, sf, "candidates").select("candidate_id").distinct().select("candidate_id", F.concat(F.lit("Candidate "), F.upper(F.substring("candidate_id", 1, 8))).alias("shown"))


# ------------------------------------------------------------------ scoring

WEIGHTS = S.Weights()


def _coverage_sql(column: str, wanted: list[str]) -> str:
    if not wanted:
        return "0.5"
    return f"len(list_filter({_list(wanted)}, lambda w: list_contains(list_transform({column}, lambda x: lower(x)), w))) / {float(len(wanted))}"


def _components_sql(r: G.Request) -> str:
    lo, hi = float(r.min_years or 0), float(r.max_years or 99)
    experience = (
        "0.5" if r.min_years is None and r.max_years is None else
        f"CASE WHEN years IS NULL THEN 0.4 WHEN years BETWEEN {lo} AND {hi} THEN 1.0 WHEN years < {lo} THEN greatest(0.0, 1 - ({lo} - years) / {max(lo, 1.0)}) ELSE greatest(0.35, 1 - (years - {hi}) / 20) END"
    )
    parts = [f"{_coverage_sql(c, r.wanted(c))}::DOUBLE AS c_{c}" for c in S.LISTS]
    return f"SELECT candidate_id, {', '.join(parts)}, ({experience})::DOUBLE AS c_experience, quality::DOUBLE AS c_quality"


def _total_sql(w: S.Weights) -> str:
    return "round(" + " + ".join(f"{v!r} * c_{k}" for k, v in w.normalised().items()) + ", 4)"


_SCORED = f"{_VIEW}, {_gate_sql(REQUEST)}, comps AS ({_components_sql(REQUEST)} FROM gated WHERE len(reasons) = 0), scored AS (SELECT *, {_total_sql(WEIGHTS)} AS total FROM comps)"


@registry.query(_SCORED + " SELECT candidate_id, " + ", ".join(f"round(c_{k}, 4) AS c_{k}" for k in WEIGHTS.normalised()) + ", total FROM scored")
def score_components(spark, sf):
    s = S.score(G.gate(G.scorable(spark, sf), REQUEST).where("kept"), REQUEST, WEIGHTS)
    return s.select("candidate_id", *[F.round(f"c_{k}", 4).alias(f"c_{k}") for k in WEIGHTS.normalised()], "total")


@registry.query(_SCORED + " SELECT candidate_id, total, CAST(row_number() OVER (ORDER BY total DESC, candidate_id) AS INT) AS place FROM scored QUALIFY place <= 25")
def rank_candidates(spark, sf):
    """The 25 best by total, then id: a top-k report."""
    return S.ranked(S.score(G.gate(G.scorable(spark, sf), REQUEST).where("kept"), REQUEST, WEIGHTS), 25)


@registry.query(
    _VIEW + " SELECT candidate_id, dim, item, CASE WHEN list_contains(have, item) THEN 'has' WHEN len(have) = 0 THEN 'unknown' ELSE 'lacks' END AS verdict FROM ("
    + " UNION ALL ".join(f"SELECT candidate_id, '{c}' AS dim, unnest({_list(REQUEST.wanted(c))}) AS item, list_transform({c}, lambda x: lower(x)) AS have FROM v" for c in S.LISTS if REQUEST.wanted(c)) + ")"
)
def gap_analysis(spark, sf):
    """What each candidate has, lacks, and what is not known about them."""
    return S.gaps(G.scorable(spark, sf), REQUEST)


def _scenario_rows() -> str:
    rows = []
    for name, w in S.scenarios(WEIGHTS):
        rows.append(f"('{name}', " + ", ".join(repr(v) for v in w.normalised().values()) + ")")
    return f"sc(scenario, {', '.join(f'w_{k}' for k in WEIGHTS.normalised())}) AS (VALUES {', '.join(rows)})"


_WSUM = "round(" + " + ".join(f"w_{k} * c_{k}" for k in WEIGHTS.normalised()) + ", 4)"


@registry.query(
    f"""{_SCORED}, {_scenario_rows()}, base AS (SELECT candidate_id, row_number() OVER (ORDER BY total DESC, candidate_id) AS b FROM scored QUALIFY b <= 10),
    r AS (SELECT scenario, candidate_id, row_number() OVER (PARTITION BY scenario ORDER BY {_WSUM} DESC, candidate_id) AS n FROM comps CROSS JOIN sc),
    m AS (SELECT candidate_id, CAST(b AS INT) AS base_rank, max(abs(n - b)) AS worst, round(avg(abs(n - b)), 2) AS mean_shift FROM r JOIN base USING (candidate_id) GROUP BY ALL)
    SELECT candidate_id, base_rank, CAST(worst AS INT) AS max_rank_shift, mean_shift AS mean_abs_shift, CASE WHEN worst <= 1 THEN 'robust' WHEN worst <= 3 THEN 'sensitive' ELSE 'unstable' END AS verdict FROM m"""
)
def weight_sensitivity(spark, sf):
    comps = S.components(G.gate(G.scorable(spark, sf), REQUEST).where("kept"), REQUEST)
    return S.sensitivity(materialise(comps, "components"), WEIGHTS)


def _edit_parts() -> list[str]:
    out = []
    for name, r in S.edits(REQUEST):
        scored = f"SELECT candidate_id, row_number() OVER (ORDER BY {_total_sql(WEIGHTS)} DESC, candidate_id) AS n FROM ({_components_sql(r)} FROM (WITH {_gate_sql(r)} SELECT * FROM gated WHERE len(reasons) = 0))"
        out.append(f"SELECT '{name}' AS edit, candidate_id, n FROM ({scored})")
    return out


@registry.query(
    f"""{_VIEW}, {_gate_sql(REQUEST)}, comps AS ({_components_sql(REQUEST)} FROM gated WHERE len(reasons) = 0), base AS (SELECT candidate_id, row_number() OVER (ORDER BY {_total_sql(WEIGHTS)} DESC, candidate_id) AS b FROM comps),
    target AS (SELECT candidate_id, b FROM base WHERE b = 20), e AS ({' UNION ALL '.join(_edit_parts())}),
    up AS (SELECT e.edit, CAST(t.b AS INT) AS from_rank, CAST(e.n AS INT) AS new_rank, CAST(row_number() OVER (ORDER BY e.n, NOT starts_with(e.edit, 'drop must'), e.edit) AS INT) AS nth FROM e JOIN target t USING (candidate_id) WHERE e.n < t.b QUALIFY nth <= 8)
    SELECT *, new_rank <= 3 AND nth = (SELECT min(nth) FROM up WHERE new_rank <= 3) AS minimal FROM up"""
)
def minimal_edit(spark, sf):
    """Single removals of a requirement that lift the candidate in the 20th place, the eight that lift it most; the first
    that leads among the three best is the minimal one."""
    up = S.minimal_edit(materialise(G.scorable(spark, sf), "scorable"), REQUEST, WEIGHTS, 20)
    order = Window.orderBy("new_rank", ~F.startswith("edit", F.lit("drop must")), "edit")  # a row a removal
    up = up.withColumn("nth", F.row_number().over(order)).where("nth <= 8")
    best = F.min(F.when(F.col("new_rank") <= 3, F.col("nth"))).over(Window.partitionBy(F.lit(1)))
    return up.withColumn("minimal", F.coalesce((F.col("new_rank") <= 3) & (F.col("nth") == best), F.lit(False)))
