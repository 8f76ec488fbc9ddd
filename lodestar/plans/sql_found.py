"""SQL twins of the general problems' queries."""


def _month(column: str) -> str:
    """DuckDB: the month index of a column of loose dates."""
    t = f"replace(replace(lower(trim({column})), '’', ''''), '‘', '''')"
    named = r"\b((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]{0,6})[\s.\-'']*''?([0-9]{4}|[0-9]{2})(?:[^0-9]|$)"
    months = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
    year = f"try_cast(regexp_extract({t}, '{named}', 2) AS INT)"
    return f"""CASE
        WHEN regexp_matches({t}, '\\b(present|current|till date|till now|now|ongoing|today)\\b') THEN 2025 * 12 + 12
        WHEN regexp_matches({t}, '\\b(19|20)[0-9]{{2}}-(0[1-9]|1[0-2])\\b') THEN
            CAST(regexp_extract({t}, '\\b((?:19|20)[0-9]{{2}})-(0[1-9]|1[0-2])\\b', 1) AS INT) * 12
            + CAST(regexp_extract({t}, '\\b((?:19|20)[0-9]{{2}})-(0[1-9]|1[0-2])\\b', 2) AS INT)
        WHEN (CASE WHEN {year} < 100 THEN {year} + 2000 ELSE {year} END) BETWEEN 1950 AND 2099 THEN
            (CASE WHEN {year} < 100 THEN {year} + 2000 ELSE {year} END) * 12
            + list_position({months}, substr(regexp_extract({t}, '{named}', 1), 1, 3))
        WHEN regexp_matches({t}, '\\b(0?[1-9]|1[0-2])/(19|20)[0-9]{{2}}\\b') THEN
            CAST(regexp_extract({t}, '\\b(0?[1-9]|1[0-2])/((?:19|20)[0-9]{{2}})\\b', 2) AS INT) * 12
            + CAST(regexp_extract({t}, '\\b(0?[1-9]|1[0-2])/((?:19|20)[0-9]{{2}})\\b', 1) AS INT)
        WHEN regexp_matches({t}, '\\b(19|20)[0-9]{{2}}\\b') THEN
            CAST(regexp_extract({t}, '\\b((?:19|20)[0-9]{{2}})\\b', 1) AS INT) * 12 + 6
        END"""


def _whole_month(column: str) -> str:
    """DuckDB: the month index of a text that is a month or a year as a whole, as the statement lists them."""
    t = f"regexp_replace(replace(replace(lower(trim(regexp_replace({column}, '[ \\t\\n\\r\\f]+', ' ', 'g'))), '’', ''''), '‘', ''''), '^since ', '')"
    part = lambda pattern, k: f"CAST(regexp_extract({t}, '{pattern}', {k}) AS INT)"
    iso, slash, bare = "^((?:19|20)[0-9]{2})-(0[1-9]|1[0-2])$", "^(0?[1-9]|1[0-2])/((?:19|20)[0-9]{2})$", "^((?:19|20)[0-9]{2})$"
    cases = []
    for n, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1):
        for digits, lead in (("(?:19|20)[0-9]{2}", ""), ("[0-9]{2}", "20")):
            pattern = f"^{m}[a-z]{{0,6}}[ .''-]*({digits})$"
            cases.append(f"WHEN regexp_matches({t}, '{pattern}') THEN CAST('{lead}' || regexp_extract({t}, '{pattern}', 1) AS INT) * 12 + {n}")
    return f"""CASE WHEN {t} IN ('present', 'till date', 'current') THEN 2025 * 12 + 12
        WHEN regexp_matches({t}, '{iso}') THEN {part(iso, 1)} * 12 + {part(iso, 2)}
        WHEN regexp_matches({t}, '{slash}') THEN {part(slash, 2)} * 12 + {part(slash, 1)}
        WHEN regexp_matches({t}, '{bare}') THEN {part(bare, 1)} * 12 + 6 {" ".join(cases)} END"""


def _label(index: str) -> str:
    return f"lpad(CAST(({index} - 1) // 12 AS VARCHAR), 4, '0') || '-' || lpad(CAST(({index} - 1) % 12 + 1 AS VARCHAR), 2, '0')"


P4_FOUND = f"""
WITH roles AS (
    SELECT candidate_id, {_whole_month("start")} AS s,
        CASE WHEN trim(coalesce("end", '')) = '' AND is_current THEN 2025 * 12 + 12 ELSE {_whole_month('"end"')} END AS e
    FROM employment
), usable AS (SELECT DISTINCT candidate_id, s, e FROM roles WHERE e > s),
reach AS (
    SELECT *, max(e) OVER (PARTITION BY candidate_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered
    FROM usable
), islands AS (
    SELECT *, sum(CASE WHEN covered IS NULL OR s > covered THEN 1 ELSE 0 END)
        OVER (PARTITION BY candidate_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island
    FROM reach
), periods AS (
    SELECT candidate_id, min(s) AS s, max(e) AS e FROM islands GROUP BY candidate_id, island
), following AS (
    SELECT *, lead(s) OVER (PARTITION BY candidate_id ORDER BY s) AS next_s FROM periods
)
SELECT candidate_id, 'period' AS kind, {_label("s")} AS from_month, {_label("e")} AS to_month FROM following
UNION ALL
SELECT candidate_id, 'gap' AS kind, {_label("e")} AS from_month, {_label("next_s")} AS to_month FROM following
WHERE next_s IS NOT NULL
"""


def _items(value: str) -> str:
    """DuckDB: the elements of a JSON value as a list; a lone value is a list of one, null is none."""
    return f"""CASE json_type({value}) WHEN 'ARRAY' THEN from_json({value}, '["JSON"]') WHEN 'NULL' THEN [] ELSE [{value}] END"""


P6_FOUND = f"""
WITH newest AS (
    SELECT candidate_id, arg_max(payload, updated_at) AS payload FROM candidates GROUP BY candidate_id
), once AS (
    SELECT candidate_id, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM newest
), parsed AS (
    SELECT candidate_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN CAST(j ->> '$' AS JSON) END ELSE j END AS j FROM once
), profiles AS (
    SELECT candidate_id, coalesce(j -> '$.data', j) AS p FROM parsed WHERE json_type(j) = 'OBJECT'
), strategies AS (
    SELECT candidate_id, unnest(s) AS v, generate_subscripts(s, 1) - 1 AS pos
    FROM (SELECT candidate_id, {_items("p -> '$.strategies'")} AS s FROM profiles WHERE json_exists(p, '$.strategies'))
), labelled AS (
    SELECT candidate_id, v, pos,
        coalesce(CASE json_type(v) WHEN 'VARCHAR' THEN v ->> '$' WHEN 'OBJECT' THEN v ->> '$.label' END, '') AS label
    FROM strategies
), roles AS (
    SELECT candidate_id, unnest(s) AS v, generate_subscripts(s, 1) - 1 AS pos
    FROM (SELECT candidate_id, {_items("p -> '$.employment'")} AS s FROM profiles WHERE json_exists(p, '$.employment'))
), triggers AS (
    SELECT candidate_id, pos AS parent_pos, generate_subscripts(s, 1) - 1 AS pos, label
    FROM (SELECT candidate_id, pos, label, {_items("v -> '$.triggers'")} AS s FROM labelled WHERE json_exists(v, '$.triggers'))
), highlights AS (
    SELECT candidate_id, pos AS parent_pos, generate_subscripts(s, 1) - 1 AS pos
    FROM (SELECT candidate_id, pos, {_items("v -> '$.highlights'")} AS s FROM roles WHERE json_exists(v, '$.highlights'))
)
SELECT candidate_id, 'strategy' AS child, CAST(-1 AS INT) AS parent_pos, CAST(pos AS INT) AS pos, label FROM labelled
UNION ALL SELECT candidate_id, 'trigger', CAST(parent_pos AS INT), CAST(pos AS INT), label FROM triggers
UNION ALL SELECT candidate_id, 'role', -1, CAST(pos AS INT), '' FROM roles
UNION ALL SELECT candidate_id, 'highlight', CAST(parent_pos AS INT), CAST(pos AS INT), '' FROM highlights
"""
