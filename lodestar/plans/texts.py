"""Queries over documents: cleaning, quality, language, contacts, injections, lines, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import texts as O
from ..tables import load
from .registry import Registry

registry = Registry()


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _clean_sql() -> str:
    s = f"regexp_replace(text, {q(T.INVISIBLE)}, '', 'g')"
    for k, v in T.REPLACED.items():
        s = f"replace({s}, {q(k)}, {q(v)})"
    s = f"regexp_replace({s}, {q(T.BULLETS)}, {q(' ' + chr(0x2022) + ' ')}, 'g')"
    s = f"regexp_replace({s}, '([\\p{{L}}\\p{{N}}_])-\\n\\s*([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g')"
    for _ in range(2):  # no look-ahead here: the second pass takes what the first has left
        s = f"regexp_replace({s}, '([a-z,;])\\n([a-z])', '\\1 \\2', 'g')"
    s = f"regexp_replace({s}, '[ \\t]+', ' ', 'g')"
    s = f"regexp_replace({s}, ' *\\n *', chr(10), 'g')"
    s = f"regexp_replace({s}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({s}, '^[ \\t\\n\\f\\r]+|[ \\t\\n\\f\\r]+$', '', 'g')"


def _n(pattern: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, {q(pattern)}))"


@registry.query(f"SELECT doc_id, md5({_clean_sql()}) AS digest, length({_clean_sql()}) AS n FROM documents")
def text_clean_md5(spark, sf):
    c = T.clean_text(F.col("text"))
    return load(spark, sf, "documents").select("doc_id", c.alias("c")).select("doc_id", F.md5("c").alias("digest"), F.length("c").alias("n"))


_DAMAGED = f"[{T.DAMAGED}]"
_HYPHEN = r"[\p{L}\p{N}_]-\n\s*[\p{L}\p{N}_]"


@registry.query(
    f"SELECT doc_id, {_n(T.INVISIBLE)} AS invisible, {_n(_DAMAGED)} AS ligatures, {_n(T.BULLETS)} AS bullets, {_n(_HYPHEN)} AS hyphen_wraps FROM documents WHERE text IS NOT NULL"
)
def text_repairs(spark, sf):
    return load(spark, sf, "documents").where("text is not null").select("doc_id", *[c.alias(k) for k, c in T.repair_counts(F.col("text")).items()])


_QUALITY = f"""CASE WHEN text IS NULL THEN NULL WHEN length(text) < 200 THEN 0.05 ELSE round(greatest(0.0, least(1.0,
    0.35 * {_n('[A-Za-z0-9]')} / greatest(1, length(text))
    + 0.30 * len(list_filter(regexp_extract_all(text, '[A-Za-z]{{2,}}'), lambda w: regexp_matches(w, '[aeiouAEIOU]'))) / greatest(1, {_n('[A-Za-z]{2,}')})
    + 0.20 * least(1.0, (list_sum(list_transform(lines, lambda x: length(x))) / greatest(1, len(lines))) / 40)
    + 0.15 * (1 - least(1.0, {_n('[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')} / greatest(1, length(text)) * 20)))), 3) END"""
_LINED = "(SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\f\\r]')) AS lines FROM documents)"


@registry.query(f"SELECT doc_id, CAST({_QUALITY} AS DOUBLE) AS quality FROM {_LINED}")
def text_quality(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.extraction_quality(F.col("text")).alias("quality"))


@registry.query(
    f"""WITH s AS (SELECT source, CAST({_QUALITY} AS DOUBLE) AS quality FROM {_LINED})
    SELECT source, CASE WHEN quality >= 0.8 THEN 'high' WHEN quality >= 0.55 THEN 'medium' WHEN quality IS NOT NULL THEN 'low' END AS tier, count(*) AS n FROM s GROUP BY 1, 2"""
)
def text_quality_tier(spark, sf):
    s = load(spark, sf, "documents").select("source", T.extraction_quality(F.col("text")).alias("quality"))
    return s.groupBy("source", T.quality_tier(F.col("quality")).alias("tier")).agg(F.count("*").alias("n"))


def _stop(code: str) -> str:
    return f"len(list_filter(w, lambda x: x IN ({', '.join(map(q, T.STOP_WORDS[code]))})))"


@registry.query(
    f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
    c AS (SELECT doc_id, {', '.join(f'{_stop(k)} AS {k}' for k in T.STOP_WORDS)} FROM t)
    SELECT doc_id, CASE greatest(en, fr, es, pt) WHEN en THEN 'en' WHEN fr THEN 'fr' WHEN es THEN 'es' WHEN pt THEN 'pt' END AS guess,
        round(greatest(en, fr, es, pt) / greatest(1, en + fr + es + pt), 3) AS share FROM c"""
)
def language_guess(spark, sf):
    return O.language_guess(load(spark, sf, "documents"), "doc_id", "text")


_INVENTORY = {"lines": "\\n", "dates": "\\b(?:19|20)[0-9]{2}\\b", "emails": "[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}", "phones": "\\+?[0-9][0-9\\-().]{8,}[0-9]", "wide": "[^\\x00-\\x7F]"}


@registry.query(f"SELECT doc_id, length(text) AS chars, sha256(text) AS digest, {', '.join(f'{_n(p)} AS {k}' for k, p in _INVENTORY.items())} FROM documents WHERE text IS NOT NULL")
def corpus_inventory(spark, sf):
    d = load(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("digest"), *[F.regexp_count("text", F.lit(p)).alias(k) for k, p in _INVENTORY.items()])


@registry.query(f"SELECT doc_id, md5(trim(regexp_replace(translate(lower(translate(text, 'İ', 'I')), {q(T.MARKED)}, {q(T.PLAIN)}), '[ \\t\\n\\f\\r]+', ' ', 'g'))) AS digest FROM documents")
def normalise_text(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.md5(T.normalise(F.col("text"))).alias("digest"))


_REDACT = "regexp_replace(regexp_replace(text, '[\\w.\\-+]+@[\\w\\-]+\\.\\w+', '<email>', 'g'), '(\\+?[0-9][0-9\\s\\-().]{8,}[0-9])', '<phone>', 'g')"


@registry.query(f"SELECT doc_id, md5({_REDACT}) AS digest FROM documents")
def pii_redact(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.md5(T.redact_contacts(F.col("text"))).alias("digest"))


@registry.query(
    f"""WITH r AS (SELECT source, {_REDACT} AS t FROM documents WHERE text IS NOT NULL)
    SELECT source, sum(len(regexp_extract_all(t, '<email>'))) AS emails, sum(len(regexp_extract_all(t, '<phone>'))) AS phone_like, count(*) AS n FROM r GROUP BY 1"""
)
def pii_counts(spark, sf):
    r = load(spark, sf, "documents").where("text is not null").select("source", T.redact_contacts(F.col("text")).alias("t"))
    return r.groupBy("source").agg(F.sum(F.regexp_count("t", F.lit("<email>"))).alias("emails"), F.sum(F.regexp_count("t", F.lit("<phone>"))).alias("phone_like"), F.count("*").alias("n"))


_CONTACT = "[A-Za-z0-9._%+\\-]*@[A-Za-z0-9.\\-]*"


@registry.query(
    f"""WITH e AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_CONTACT}')) AS value FROM documents WHERE text IS NOT NULL)
    SELECT value, CASE WHEN regexp_matches(value, '^[A-Za-z0-9._%+\\-]+@[A-Za-z0-9\\-]+(\\.[A-Za-z0-9\\-]+)*\\.[A-Za-z]{{2,}}$') THEN NULL ELSE 'malformed' END AS problem FROM e"""
)
def email_check(spark, sf):
    e = load(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(_CONTACT), F.lit(0))).alias("value")).distinct()
    return e.select("value", T.email_problem(F.col("value")).alias("problem"))


@registry.query()
def injection_scan_full(spark, sf):
    """All families with look-around and back-reference, which the SQL engine lacks; fixtures check them."""
    return O.injection_findings(load(spark, sf, "documents"), "doc_id", "text")


_SIMPLE = [x for x in T.INJECTIONS if x[0] in ("instruction_override", "fake_turn_marker", "model_directive", "hidden_html_comment", "invisible_chars")]


@registry.query("WITH c AS (SELECT doc_id, unnest([" + ", ".join(f"{{'family': {q(n)}, 'hits': {_n(p)}}}" for n, p, _ in _SIMPLE) + "]) AS x FROM documents WHERE text IS NOT NULL) SELECT doc_id, x.family AS family, x.hits AS hits FROM c WHERE x.hits > 0")
def injection_scan_simple(spark, sf):
    """The families the SQL engine's patterns can express, each on the raw text."""
    rows = F.array(*[F.struct(F.lit(n).alias("family"), F.regexp_count("text", F.lit(p)).alias("hits")) for n, p, _ in _SIMPLE])
    return load(spark, sf, "documents").select("doc_id", F.explode(rows).alias("x")).select("doc_id", "x.*").where("hits > 0")


@registry.query("WITH c AS (SELECT doc_id, unnest([" + ", ".join(f"{{'family': {q(n)}, 'severity': '{s}', 'place': instr(text, regexp_extract(text, {q(p)})) - 1, 'snippet': substr(regexp_extract(text, {q(p)}), 1, 180)}}" for n, p, s in _SIMPLE) + "]) AS x FROM documents WHERE text IS NOT NULL) SELECT doc_id, x.family AS family, x.severity AS severity, CAST(x.place AS INT) AS place, x.snippet AS snippet FROM c WHERE x.snippet <> ''")
def injection_places(spark, sf):
    """The first place of each of these families in each text, with what stands there, up to 180 characters."""
    found = lambda p: F.regexp_extract("text", p, 0)
    rows = F.array(*[F.struct(F.lit(n).alias("family"), F.lit(s).alias("severity"), (F.instr(F.col("text"), found(p)) - 1).alias("place"), F.substring(found(p), 1, 180).alias("snippet")) for n, p, s in _SIMPLE])
    return load(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(rows).alias("x")).select("doc_id", "x.*").where("snippet <> ''")


@registry.query(
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM l)
    SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(sum(length(line) + 1) OVER w - length(line) - 1 AS INT) AS char_start,
        CAST(sum(length(line) + 1) OVER w - 1 AS INT) AS char_end, line FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)"""
)
def lines_offsets(spark, sf):
    return O.lines_with_offsets(load(spark, sf, "documents"), "doc_id", "text")


_SECTION = "CASE " + " ".join(f"WHEN regexp_matches(n, {q('^(' + p + ')$')}) THEN '{k}'" for k, p in O.SECTIONS.items()) + " END"


@registry.query(
    f"""WITH o AS ({registry.sql['lines_offsets']}), n AS (SELECT doc_id, char_start, regexp_replace(trim(regexp_replace(translate(lower(translate(line, 'İ', 'I')), {q(T.MARKED)}, {q(T.PLAIN)}), '[ \\t\\n\\f\\r]+', ' ', 'g')), ' ?:$', '') AS n FROM o
        WHERE length(line) <= 60 AND regexp_matches(line, '^[^\\p{{L}}]*\\p{{Lu}}')),
    h AS (SELECT doc_id, char_start, section, lead(char_start) OVER (PARTITION BY doc_id ORDER BY char_start) AS following FROM (SELECT *, {_SECTION} AS section FROM n) WHERE section IS NOT NULL)
    SELECT doc_id, section, CAST(min(char_start) AS INT) AS char_start, CAST(max(coalesce(following, length(text))) AS INT) AS char_end FROM h JOIN documents USING (doc_id) GROUP BY 1, 2"""
)
def section_segments(spark, sf):
    return O.section_segments(load(spark, sf, "documents"), "doc_id", "text")


@registry.query(
    """WITH g AS (SELECT text, min(doc_id) AS first_key, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1)
    SELECT doc_id, first_key, copies FROM documents JOIN g USING (text)"""
)
def exact_duplicates(spark, sf):
    return O.exact_duplicates(load(spark, sf, "documents"), "doc_id", "text")


@registry.query(
    """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) AS s FROM w WHERE len(w) >= 5),
    o AS (SELECT min(doc_id) AS id, s FROM s GROUP BY s), g AS (SELECT id, len(s) AS n, unnest(s) AS g FROM o),
    c AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
    SELECT a AS doc_id_a, b AS doc_id_b, round(i / (na + nb - i), 4) AS jaccard FROM c WHERE i / (na + nb - i) >= 0.55"""
)
def near_duplicate_pairs(spark, sf):
    return O.shingle_pairs(load(spark, sf, "documents"), "doc_id", "text", 0.55)


@registry.query(
    """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) AS s FROM w WHERE len(w) >= 5)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS copies FROM s"""
)
def near_duplicate_members(spark, sf):
    """The class of every document with five words or more; `near_duplicate_pairs` links classes."""
    return O.shingle_classes(load(spark, sf, "documents"), "doc_id", "text")
