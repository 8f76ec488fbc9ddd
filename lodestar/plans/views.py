"""The candidate-shaped views once more as common table expressions of SQL."""

from .sql_found import _month

PROFILES = """profiles AS (
    SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY updated_at DESC NULLS LAST, approach DESC NULLS LAST, completeness DESC NULLS LAST, country DESC NULLS LAST, feeder_path DESC NULLS LAST, is_synthetic DESC NULLS LAST, near_duplicate_of DESC NULLS LAST, needs_review DESC NULLS LAST, region DESC NULLS LAST, seniority_level DESC NULLS LAST, source_file DESC NULLS LAST, years_experience DESC NULLS LAST, payload DESC NULLS LAST) AS rn FROM candidates) WHERE rn = 1
)"""

PARSED = """once AS (SELECT candidate_id, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM profiles),
read AS (SELECT candidate_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN CAST(j ->> '$' AS JSON) END ELSE j END AS j FROM once),
parsed AS (SELECT candidate_id, coalesce(j -> '$.data', j) AS p FROM read WHERE json_type(j) = 'OBJECT')"""

SKILLS = """skills AS (
    SELECT DISTINCT candidate_id, x ->> '$.canonical' AS skill, x ->> '$.depth' AS depth
    FROM (SELECT candidate_id, unnest(from_json(p -> '$.skills', '["JSON"]')) AS x FROM parsed WHERE json_type(p -> '$.skills') = 'ARRAY')
    WHERE x ->> '$.canonical' IS NOT NULL
)"""

STRATEGIES = """strategies AS (
    SELECT DISTINCT candidate_id, CASE json_type(x) WHEN 'VARCHAR' THEN x ->> '$' ELSE x ->> '$.label' END AS strategy
    FROM (SELECT candidate_id, unnest(CASE json_type(p -> '$.strategies') WHEN 'ARRAY' THEN from_json(p -> '$.strategies', '["JSON"]') WHEN 'NULL' THEN [] ELSE [p -> '$.strategies'] END) AS x
        FROM parsed WHERE json_exists(p, '$.strategies'))
    WHERE coalesce(CASE json_type(x) WHEN 'VARCHAR' THEN x ->> '$' ELSE x ->> '$.label' END, '') <> ''
)"""

ROLES = f"""roles AS (
    SELECT * EXCLUDE (rn), {_month("start")} AS s,
        CASE WHEN trim(coalesce("end", '')) = '' AND is_current THEN 2025 * 12 + 12 ELSE {_month('"end"')} END AS e
    FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, seq ORDER BY ingested_at DESC NULLS LAST, recorded_at DESC NULLS LAST, start DESC NULLS LAST, "end" DESC NULLS LAST, title DESC NULLS LAST) AS rn FROM employment)
    WHERE rn = 1
)"""

#: The union of all, for a query that begins with them.
ALL = f"WITH {PROFILES}, {PARSED}, {SKILLS}, {STRATEGIES}"
