"""Queries that read facts about people out of whole documents and weigh them: words, certificates, languages,
places, contacts, identity, depth of skills, profile, way in, seniority."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.dates import let
from ..operators import extract as X
from ..operators import profiles as P
from ..tables import load
from . import careers
from .registry import Registry
from .texts import q
from .views import PARSED, PROFILES, ROLES

registry = Registry()

#: Documents with their normalised, spaced text; null and empty texts hold no words.
_N = f"n AS (SELECT doc_id, candidate_id, {V.spaced_sql('text')} AS n FROM documents WHERE text IS NOT NULL)"


def _spaced(spark, sf) -> DataFrame:
    return load(spark, sf, "documents").where("text is not null").select("doc_id", "candidate_id", V.spaced(F.col("text")).alias("n"))


def _hits_sql(name: str, vocabulary: dict[str, str]) -> str:
    return f"{name} AS (SELECT doc_id, candidate_id, n, x.label AS label, x.word AS word, x['spot'] AS spot, x.hits AS hits FROM (SELECT doc_id, candidate_id, n, unnest({V.word_hits_sql('n', vocabulary)}) AS x FROM n))"


def _hits(df: DataFrame, vocabulary: dict[str, str], *keep: str) -> DataFrame:
    """(`keep`, `label`, `word`, `spot`, `hits`) of every word of a vocabulary that occurs in the column `n`."""
    return df.select(*keep, F.explode(V.word_hits(F.col("n"), vocabulary)).alias("x")).select(*keep, "x.*")


# ------------------------------------------------------------------ words

@registry.query(f"WITH {_N}, {_hits_sql('h', V.SKILLS)} SELECT doc_id, label, CAST(sum(hits) AS BIGINT) AS hits, CAST(min(spot) AS INT) AS first_at FROM h GROUP BY 1, 2")
def skill_mentions(spark, sf):
    """Skills named in each document, `C++` and `C#` among them, with their number and first place."""
    return _hits(_spaced(spark, sf), V.SKILLS, "doc_id").groupBy("doc_id", "label").agg(F.sum("hits").alias("hits"), F.min("spot").alias("first_at"))


_LINES = f"""l AS (SELECT doc_id, candidate_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
    n AS (SELECT doc_id, candidate_id, length(line) AS size, length(line) - length(replace(line, ',', '')) AS commas, {V.spaced_sql('line')} AS n FROM l),
    {_hits_sql('h', V.SKILLS).replace('SELECT doc_id, candidate_id, n,', 'SELECT doc_id, candidate_id, n, size, commas,').replace('n, x.label', 'n, size, commas, x.label')}"""
_APPLIED = "size > 60 AND NOT (commas >= 3 AND size < 260)"
_DEPTH = f"""d AS (SELECT candidate_id, label, CAST(sum(hits) AS BIGINT) AS hits, CAST(coalesce(sum(hits) FILTER ({_APPLIED}), 0) AS BIGINT) AS applied FROM h GROUP BY 1, 2),
    depths AS (SELECT *, CASE WHEN applied >= 2 OR hits >= 4 THEN 'core' WHEN applied >= 1 THEN 'applied' ELSE 'mentioned' END AS depth FROM d)"""


def _depths(spark, sf) -> DataFrame:
    lines = load(spark, sf, "documents").where("text is not null").select("candidate_id", F.explode(F.split("text", "\n")).alias("line"))
    commas = F.length("line") - F.length(F.replace("line", F.lit(","), F.lit("")))
    rows = _hits(lines.select("candidate_id", F.length("line").alias("size"), commas.alias("commas"), V.spaced(F.col("line")).alias("n")), V.SKILLS, "candidate_id", "size", "commas")
    d = rows.groupBy("candidate_id", "label").agg(F.sum("hits").alias("hits"), F.sum(F.when(F.expr(_APPLIED), F.col("hits")).otherwise(0)).alias("applied"))
    return d.withColumn("depth", F.when((F.col("applied") >= 2) | (F.col("hits") >= 4), "core").when(F.col("applied") >= 1, "applied").otherwise("mentioned"))


@registry.query(f"WITH {_LINES}, {_DEPTH} SELECT candidate_id, label, hits, applied, depth FROM depths")
def skill_depth_lines(spark, sf):
    """How deeply a skill is shown by the lines that name it: a list of tools mentions, a longer line applies, and what recurs is core."""
    return _depths(spark, sf)


_FAMILIES = "count(*) FILTER (label IN (" + ", ".join(map(q, V.QUANTITATIVE)) + ")) AS quant, count(*) FILTER (label IN (" + ", ".join(map(q, V.FUNDAMENTAL)) + ")) AS fundamental"
_CREDIT = " + ".join(f"(length(n) - length(replace(n, {q(w)}, ''))) // {len(w)}" for w in V.CREDIT_WORDS)


@registry.query(
    f"""WITH {_N}, {_hits_sql('h', V.SKILLS)}, f AS (SELECT candidate_id, {_FAMILIES} FROM (SELECT DISTINCT candidate_id, label FROM h) GROUP BY 1), c AS (SELECT candidate_id, CAST(sum({_CREDIT}) AS BIGINT) AS credit FROM n GROUP BY 1)
    SELECT candidate_id, coalesce(quant, 0) AS quant, coalesce(fundamental, 0) AS fundamental, credit, CASE WHEN credit >= 4 AND coalesce(fundamental, 0) >= 1 THEN 'credit' WHEN quant >= 3 AND fundamental >= 2 THEN 'hybrid' WHEN quant >= 3 THEN 'quantitative' WHEN fundamental >= 1 THEN 'fundamental' END AS label
    FROM c LEFT JOIN f USING (candidate_id)"""
)
def quant_profile(spark, sf):
    """Quantitative, fundamental, both or credit, by families of skills and words of credit; NULL where too little speaks."""
    n = _spaced(spark, sf)
    families = _hits(n, V.SKILLS, "candidate_id").select("candidate_id", "label").distinct().groupBy("candidate_id").agg(
        F.count_if(F.col("label").isin(V.QUANTITATIVE)).alias("quant"), F.count_if(F.col("label").isin(V.FUNDAMENTAL)).alias("fundamental")
    )
    credit = let(F.col("n"), lambda t: sum(((F.length(t) - F.length(F.replace(t, F.lit(w), F.lit("")))) / len(w) for w in V.CREDIT_WORDS), F.lit(0.0)))
    c = n.groupBy("candidate_id").agg(F.sum(credit.cast("long")).alias("credit")).join(families, "candidate_id", "left")
    c = c.select("candidate_id", F.coalesce("quant", F.lit(0)).alias("quant"), F.coalesce("fundamental", F.lit(0)).alias("fundamental"), "credit")
    label = F.when(F.expr("credit >= 4 and fundamental >= 1"), "credit").when(F.expr("quant >= 3 and fundamental >= 2"), "hybrid").when(F.expr("quant >= 3"), "quantitative").when(F.expr("fundamental >= 1"), "fundamental")
    return c.withColumn("label", label)


# ------------------------------------------------------------------ certificates, languages

_LEVELS = {c: {s: V.listed(m) for s, m in levels.items()} for c, levels in V.CERTIFICATION_LEVELS.items()}
_STATUS = "CASE " + " ".join(f"WHEN label = '{c}' AND ({' OR '.join(f'contains(win, {q(m)})' for m in marks)}) THEN '{s}'" for c, levels in _LEVELS.items() for s, marks in levels.items()) + " END"
_CERTS = f"""{_N}, {_hits_sql('h', V.CERTIFICATIONS)}, f AS (SELECT doc_id, candidate_id, label, spot, substr(n, greatest(1, spot - 60), 200 + length(word)) AS win FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY spot, word) = 1),
    certs AS (SELECT doc_id, candidate_id, label AS certification, {_STATUS} AS status, CAST(spot AS INT) AS spot FROM f)"""


def _certifications(spark, sf) -> DataFrame:
    h = _hits(_spaced(spark, sf), V.CERTIFICATIONS, "doc_id", "candidate_id", "n")
    win = F.expr("substring(n, greatest(1, spot - 60), 200 + length(word))")
    first = h.groupBy("doc_id", "candidate_id", "label").agg(F.min_by(F.struct("spot", win.alias("win")), F.struct("spot", "word")).alias("f"))
    any_of = lambda marks: F.greatest(*[F.contains("f.win", F.lit(m)) for m in marks]) if len(marks) > 1 else F.contains("f.win", F.lit(marks[0]))
    status = F.coalesce(*[F.when((F.col("label") == c) & any_of(marks), F.lit(s)) for c, levels in _LEVELS.items() for s, marks in levels.items()])
    return first.select("doc_id", "candidate_id", F.col("label").alias("certification"), status.alias("status"), F.col("f.spot").alias("spot"))


@registry.query(f"WITH {_CERTS} SELECT doc_id, certification, status, spot FROM certs")
def certification_hits(spark, sf):
    """Certificates named in each document, with how far they were taken where the words around say so."""
    return _certifications(spark, sf).drop("candidate_id")


@registry.query(f"WITH {_CERTS} SELECT candidate_id, certification, status, doc_id FROM certs WHERE candidate_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY candidate_id, certification ORDER BY status IS NULL, doc_id) = 1")
def certifications_kept(spark, sf):
    """Each certificate of a candidate once: a row with a status goes before one without."""
    c = _certifications(spark, sf).where("candidate_id is not null")
    best = c.groupBy("candidate_id", "certification").agg(F.min_by(F.struct("status", "doc_id"), F.struct(F.col("status").isNull(), "doc_id")).alias("b"))
    return best.select("candidate_id", "certification", "b.status", "b.doc_id")


_TONGUES = {x: x for x in V.LANGUAGES}
_WELL = "CASE " + " ".join(f"WHEN contains(win, '{p}') THEN '{p}'" for p in V.PROFICIENCY) + " END"
_SPOKEN = f"{_N}, {_hits_sql('h', _TONGUES)}, spoken AS (SELECT doc_id, candidate_id, label AS language, {_WELL} AS proficiency FROM (SELECT *, substr(n, spot + 1, 90) AS win FROM h))"


def _spoken(spark, sf) -> DataFrame:
    h = _hits(_spaced(spark, sf), _TONGUES, "doc_id", "candidate_id", "n").withColumn("win", F.expr("substring(n, spot + 1, 90)"))
    well = F.coalesce(*[F.when(F.contains("win", F.lit(p)), F.lit(p)) for p in V.PROFICIENCY])
    return h.select("doc_id", "candidate_id", F.col("label").alias("language"), well.alias("proficiency"))


@registry.query(f"WITH {_SPOKEN} SELECT doc_id, language, proficiency FROM spoken")
def language_skills(spark, sf):
    """Languages a document names, with the first word for how well one is spoken in the 90 characters from there."""
    return _spoken(spark, sf).drop("candidate_id")


@registry.query(
    f"""WITH {_SPOKEN}, {PROFILES}, {PARSED}, a AS (SELECT candidate_id, lower(x ->> '$.language') AS language, max(x ->> '$.proficiency') AS proficiency FROM (SELECT candidate_id, unnest(from_json(p -> '$.languages', '["JSON"]')) AS x FROM parsed WHERE json_type(p -> '$.languages') = 'ARRAY') WHERE x ->> '$.language' IS NOT NULL GROUP BY 1, 2),
    b AS (SELECT candidate_id, language, max(proficiency) AS proficiency FROM spoken WHERE candidate_id IS NOT NULL GROUP BY 1, 2)
    SELECT candidate_id, language, coalesce(a.proficiency, b.proficiency) AS proficiency, CASE WHEN a.language IS NOT NULL AND b.language IS NOT NULL THEN 'both' WHEN a.language IS NOT NULL THEN 'first' ELSE 'second' END AS source FROM a FULL JOIN b USING (candidate_id, language)"""
)
def language_union(spark, sf):
    """Languages of the profiles and of the documents; the profile's proficiency goes first."""
    items = F.from_json(F.get_json_object(P.profile_json(F.col("payload")), "$.languages"), "array<struct<language:string,proficiency:string>>")
    a = P.profiles(spark, sf, "payload").select("candidate_id", F.explode(items).alias("x")).select("candidate_id", F.lower("x.language").alias("language"), "x.proficiency").where("language is not null")
    b = _spoken(spark, sf).where("candidate_id is not null").select("candidate_id", "language", "proficiency")
    return X.prefer_first(a, b, ["candidate_id", "language"], "proficiency")


# ------------------------------------------------------------------ places

_PLACES = {f"{region}|{country}": words for (region, country), words in V.PLACES.items()}


@registry.query(f"WITH {_N}, {_hits_sql('h', _PLACES)} SELECT doc_id, string_split(label, '|')[2] AS country, string_split(label, '|')[1] AS region, word AS place, CAST(spot AS INT) AS spot, hits, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY spot, word) AS INT) AS nth FROM h")
def place_hits(spark, sf):
    """Places a document names, in the order of their first mention."""
    h = _hits(_spaced(spark, sf), _PLACES, "doc_id")
    part = F.split("label", r"\|")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("spot", "word"))
    return h.select("doc_id", part[1].alias("country"), part[0].alias("region"), F.col("word").alias("place"), "spot", "hits", nth.alias("nth"))


_VOTES = f"""{ROLES}, {_N}, {_hits_sql('h', _PLACES)}, t AS (SELECT candidate_id, label, (CASE WHEN spot < 400 THEN 3.0 ELSE 1.0 END + (hits - 1))::DOUBLE AS votes FROM h WHERE candidate_id IS NOT NULL),
    p AS (SELECT candidate_id, {V.spaced_sql('location')} AS n, row_number() OVER (PARTITION BY candidate_id ORDER BY s DESC NULLS LAST, seq) AS r FROM roles),
    g AS (SELECT DISTINCT candidate_id, r, x.label AS label FROM (SELECT candidate_id, r, unnest({V.word_hits_sql('n', _PLACES)}) AS x FROM p WHERE r <= 2 AND n IS NOT NULL)),
    u AS (SELECT candidate_id, label, votes FROM t UNION ALL SELECT candidate_id, label, CASE r WHEN 1 THEN 12.0 ELSE 6.0 END FROM g), v AS (SELECT candidate_id, label, sum(votes) AS votes FROM u GROUP BY 1, 2),
    w AS (SELECT *, sum(votes) OVER (PARTITION BY candidate_id) AS total, row_number() OVER (PARTITION BY candidate_id ORDER BY votes DESC, label) AS rn FROM v)"""


@registry.query(f"WITH {_VOTES} SELECT candidate_id, string_split(label, '|')[2] AS country, string_split(label, '|')[1] AS region, round(least(0.96, 0.4 + 0.6 * votes / total), 4)::DOUBLE AS confidence FROM w WHERE rn = 1")
def geography_vote(spark, sf):
    """The country that most speaks for: mentions, those at the head of a document thrice, and the places of the last two roles."""
    text = _hits(_spaced(spark, sf).where("candidate_id is not null"), _PLACES, "candidate_id").select("candidate_id", "label", (F.when(F.col("spot") < 400, 3.0).otherwise(1.0) + F.col("hits") - 1).alias("votes"))
    w = Window.partitionBy("candidate_id").orderBy(F.col("s").desc_nulls_last(), "seq")
    last = P.roles(spark, sf).withColumn("r", F.row_number().over(w)).where("r <= 2 and location is not null").select("candidate_id", "r", V.spaced(F.col("location")).alias("n"))
    own = _hits(last, _PLACES, "candidate_id", "r").select("candidate_id", "r", "label").distinct().select("candidate_id", "label", F.when(F.col("r") == 1, 12.0).otherwise(6.0).alias("votes"))
    v = text.unionByName(own).groupBy("candidate_id", "label").agg(F.sum("votes").alias("votes"))
    t = v.groupBy("candidate_id").agg(F.sum("votes").alias("total"), F.min_by(F.struct("label", "votes"), F.struct(-F.col("votes"), "label")).alias("b"))
    part = F.split("b.label", r"\|")
    return t.select("candidate_id", part[1].alias("country"), part[0].alias("region"), F.round(F.least(F.lit(0.96), 0.4 + 0.6 * F.col("b.votes") / F.col("total")), 4).alias("confidence"))


# ------------------------------------------------------------------ contacts and identity

#: What an address for mail and a run like a phone number look like, and numbers of publications.
EMAIL = r"[A-Za-z0-9_.+\-]+@[A-Za-z0-9_\-]+(?:\.[A-Za-z0-9_\-]+)*"
PHONE = r"\+?[0-9][0-9 \t().\-]{7,18}[0-9]"
PUBLICATION = r"(?i)(?:ISSN|ISBN)[^0-9\n]{0,3}[0-9Xx\-]+"
YEAR = r"\b(?:19|20)[0-9]{2}\b"
#: Words of headings, and titles after a name.
HEADING = r"(?i)(experience|education|profile|summary|skills|resume|curriculum)"
TITLES_AFTER = r"(?i),?\s*(?:CFA|CPA|FRM|CAIA|PhD|MBA|MD)\b\.?"
NAME_LINE = r"^[A-Za-z][A-Za-z.,'’\-\s()]+$"
MARITAL = r"(?i)Marital\s+Status\s*[-:–]\s*([A-Za-z]+)"
MAIL_OK = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}$"


def _digits(x):
    return F.length(F.regexp_replace(x, "[^0-9]", "")).between(7, 15)


_EMAILS = f"list_transform(regexp_extract_all(text, {q(EMAIL)}), lambda x: rtrim(x, '.'))"
_PHONES = f"list_filter(list_transform(regexp_extract_all(regexp_replace(text, {q(PUBLICATION)}, ' ', 'g'), {q(PHONE)}), lambda x: trim(x)), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 7 AND 15)"


def _emails(text):
    return F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), lambda x: F.rtrim(x, F.lit(".")))


def _phones(text):
    runs = F.regexp_extract_all(F.regexp_replace(text, PUBLICATION, " "), F.lit(PHONE), F.lit(0))
    return F.filter(F.transform(runs, lambda x: F.trim(x)), _digits)


@registry.query(f"SELECT doc_id, list_sort(list_distinct({_EMAILS})) AS emails, list_sort(list_distinct({_PHONES})) AS phones, list_sort(list_distinct(regexp_extract_all(text, {q(YEAR)}))) AS years, len(regexp_extract_all(text, {q(PUBLICATION)})) AS publications FROM documents WHERE text IS NOT NULL")
def contact_facts(spark, sf):
    """Addresses for mail, phone numbers that are no number of a publication, and years of every document."""
    d = load(spark, sf, "documents").where("text is not null")
    once = lambda c: F.array_sort(F.array_distinct(c))
    t = F.col("text")
    return d.select("doc_id", once(_emails(t)).alias("emails"), once(_phones(t)).alias("phones"), once(F.regexp_extract_all(t, F.lit(YEAR), F.lit(0))).alias("years"), F.regexp_count(t, F.lit(PUBLICATION)).alias("publications"))


_HEAD = f"(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\r\\n\\f]')))[1:4]"
_NAMED = f"list_filter(list_transform({_HEAD}, lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: length(x) <= 60 AND NOT regexp_matches(x, {q(EMAIL)}) AND NOT regexp_matches(x, {q(PHONE)}) AND NOT regexp_matches(x, {q(HEADING)}) AND regexp_matches(x, {q(NAME_LINE)}))"
_FACTS = f"""{_N}, {_hits_sql('h', _PLACES)}, pl AS (SELECT doc_id, string_split(label, '|')[2] AS country FROM h WHERE spot < 900 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY spot, word) = 1),
    facts AS (SELECT d.doc_id, d.candidate_id, d.ingested_at, nullif(trim(regexp_replace(({_NAMED})[1], {q(TITLES_AFTER)}, '', 'g'), ' ,'), '') AS name, ({_EMAILS})[1] AS email, ({_PHONES})[1] AS phone, nullif(regexp_extract(text, {q(MARITAL)}, 1), '') AS marital, pl.country
        FROM documents d LEFT JOIN pl USING (doc_id) WHERE text IS NOT NULL)"""


def _facts(spark, sf) -> DataFrame:
    d = load(spark, sf, "documents").where("text is not null")
    lines = F.slice(F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^ \t\r\n\f]"))), 1, 4)
    fits = lambda x: (F.length(x) <= 60) & ~F.regexp_like(x, F.lit(EMAIL)) & ~F.regexp_like(x, F.lit(PHONE)) & ~F.regexp_like(x, F.lit(HEADING)) & F.regexp_like(x, F.lit(NAME_LINE))
    named = F.get(F.filter(F.transform(lines, lambda x: F.trim(x, F.lit(" \t\r"))), fits), F.lit(0))
    name = F.nullif(F.trim(F.regexp_replace(named, TITLES_AFTER, ""), F.lit(" ,")), F.lit(""))
    places = _hits(_spaced(spark, sf), _PLACES, "doc_id").where("spot < 900").groupBy("doc_id").agg(F.min_by("label", F.struct("spot", "word")).alias("label"))
    first = lambda c: F.get(c, F.lit(0))
    t = F.col("text")
    return d.join(places, "doc_id", "left").select(
        "doc_id", "candidate_id", "ingested_at", name.alias("name"), first(_emails(t)).alias("email"), first(_phones(t)).alias("phone"),
        F.nullif(F.regexp_extract(t, MARITAL, 1), F.lit("")).alias("marital"), F.split("label", r"\|")[1].alias("country"),
    )


@registry.query(f"WITH {_FACTS} SELECT doc_id, name, email, phone, marital, country FROM facts")
def identity_facts(spark, sf):
    """What the rules read of a document's person: the first line that can be a name, contacts, the first place, marital status."""
    return _facts(spark, sf).select("doc_id", "name", "email", "phone", "marital", "country")


_FIELDS = {"name": "full_name", "email": "email", "phone": "phone"}
_SAME = lambda c: f"regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9@]+', '', 'g')"


@registry.query(
    f"""WITH {PROFILES}, {PARSED}, {_FACTS}, latest AS (SELECT * FROM facts WHERE candidate_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY ingested_at DESC NULLS LAST, doc_id) = 1),
    m AS (SELECT candidate_id, {', '.join(f"p ->> '$.sensitive.{v}.value' AS m_{k}" for k, v in _FIELDS.items())} FROM parsed),
    j AS (SELECT candidate_id, {', '.join(f"m_{k}, {k}" for k in _FIELDS)} FROM latest LEFT JOIN m USING (candidate_id))
    SELECT candidate_id, {', '.join(f"coalesce(m_{k}, {k}) AS {k}, CASE WHEN m_{k} IS NOT NULL THEN 'model' WHEN {k} IS NOT NULL THEN 'rule' END AS {k}_source" for k in _FIELDS)},
        list_filter([{', '.join(f"CASE WHEN m_{k} IS NOT NULL AND {k} IS NOT NULL AND {_SAME(f'm_{k}')} <> {_SAME(k)} THEN '{k}' END" for k in _FIELDS)}], lambda x: x IS NOT NULL) AS conflicts,
        CASE WHEN coalesce(m_email, email) IS NULL THEN NULL WHEN regexp_matches(coalesce(m_email, email), {q(MAIL_OK)}) THEN 0.95 ELSE 0.475 END::DOUBLE AS email_confidence, coalesce(m_email, email) IS NOT NULL OR coalesce(m_phone, phone) IS NOT NULL AS contactable FROM j"""
)
def identity_merged(spark, sf):
    """The profile's own values first, the rules' where it has none, with what they disagree on; a malformed address is half as sure."""
    facts = _facts(spark, sf).where("candidate_id is not null")
    latest = facts.groupBy("candidate_id").agg(F.max_by(F.struct(*_FIELDS), F.struct("ingested_at", -F.col("doc_id"))).alias("r")).select("candidate_id", "r.*")
    profile = P.profile_json(F.col("payload"))
    model = P.profiles(spark, sf, "payload").select("candidate_id", *[F.get_json_object(profile, f"$.sensitive.{v}.value").alias(f"m_{k}") for k, v in _FIELDS.items()])
    same = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9@]+", "")
    j = latest.join(model, "candidate_id", "left")
    value = {k: F.coalesce(f"m_{k}", k) for k in _FIELDS}
    source = {k: F.when(F.col(f"m_{k}").isNotNull(), "model").when(F.col(k).isNotNull(), "rule") for k in _FIELDS}
    differ = [F.when(F.col(f"m_{k}").isNotNull() & F.col(k).isNotNull() & (same(f"m_{k}") != same(k)), F.lit(k)) for k in _FIELDS]
    sure = F.when(value["email"].isNull(), None).when(F.regexp_like(value["email"], F.lit(MAIL_OK)), 0.95).otherwise(0.475)
    return j.select(
        "candidate_id", *[c.alias(k) for k, c in value.items()], *[c.alias(f"{k}_source") for k, c in source.items()],
        F.array_compact(F.array(*differ)).alias("conflicts"), sure.alias("email_confidence"), (value["email"].isNotNull() | value["phone"].isNotNull()).alias("contactable"),
    )


# ------------------------------------------------------------------ way in, seniority, degrees, lines

def _signals(words: str) -> list[str]:
    return [w for w in words.split(", ") if w]


#: Signals are parts of the normalised text, not whole words, as surveyed.
_LOW = "trim(regexp_replace(translate(lower(translate(text, 'İ', 'I')), {}, {}), '[ \\t\\n\\f\\r]+', ' ', 'g'))".format(q(V.MARKED), q(V.PLAIN))
_SIGNALLED = "[" + ", ".join(f"{{'label': '{k}', 'votes': CAST({' + '.join(f'contains(low, {q(s)})::INT' for s in _signals(words))} AS DOUBLE)}}" for k, (words, _) in V.FEEDERS.items()) + "]"
_TIERS = ", ".join(f"('{k}', '{t}')" for k, (_, tiers) in V.FEEDERS.items() for t in _signals(tiers))
_EARLIEST = "paid AS (SELECT candidate_id, coalesce(employer_tier, 'unknown') AS tier, row_number() OVER (PARTITION BY candidate_id ORDER BY s NULLS FIRST, seq DESC) AS r FROM roles WHERE NOT coalesce(is_internship, false))"


@registry.query(
    f"""WITH {ROLES}, low AS (SELECT candidate_id, {_LOW} AS low FROM documents WHERE text IS NOT NULL AND candidate_id IS NOT NULL), t AS (SELECT candidate_id, x.label AS label, x.votes AS votes FROM (SELECT candidate_id, unnest({_SIGNALLED}) AS x FROM low)),
    {_EARLIEST}, tiers(label, tier) AS (VALUES {_TIERS}), u AS (SELECT candidate_id, label, max(votes) AS votes FROM t WHERE votes > 0 GROUP BY 1, 2 UNION ALL SELECT candidate_id, label, 2.5 FROM paid JOIN tiers USING (tier) WHERE r <= 3),
    v AS (SELECT candidate_id, label, sum(votes) AS votes FROM u GROUP BY 1, 2), w AS (SELECT *, sum(votes) OVER (PARTITION BY candidate_id) AS total, row_number() OVER (PARTITION BY candidate_id ORDER BY votes DESC, label) AS rn FROM v)
    SELECT candidate_id, label, round(least(0.92, 0.35 + 0.65 * votes / total), 3)::DOUBLE AS confidence, votes < 2 AS low_support FROM w WHERE rn = 1"""
)
def feeder_path(spark, sf):
    """The way into the trade: signals in the text, each once, and the firms of the three earliest paid roles; ties by label."""
    d = load(spark, sf, "documents").where("text is not null and candidate_id is not null").select("candidate_id", V.normalise(F.col("text")).alias("low"))
    votes = lambda low, words: sum((F.contains(low, F.lit(s)).cast("int") for s in _signals(words)), F.lit(0)).cast("double")
    rows = d.select("candidate_id", F.explode(let(F.col("low"), lambda low: F.array(*[F.struct(F.lit(k).alias("label"), votes(low, words).alias("votes")) for k, (words, _) in V.FEEDERS.items()]))).alias("x"))
    text = rows.select("candidate_id", "x.*").where("votes > 0").groupBy("candidate_id", "label").agg(F.max("votes").alias("votes"))
    w = Window.partitionBy("candidate_id").orderBy(F.col("s").asc_nulls_first(), F.col("seq").desc())
    paid = P.roles(spark, sf).where("not coalesce(is_internship, false)").withColumn("r", F.row_number().over(w)).where("r <= 3").select("candidate_id", F.coalesce("employer_tier", F.lit("unknown")).alias("tier"))
    labels = {t: [k for k, (_, tiers) in V.FEEDERS.items() if t in _signals(tiers)] for _, tiers in V.FEEDERS.values() for t in _signals(tiers)}
    own = F.coalesce(*[F.when(F.col("tier") == t, F.array(*map(F.lit, ks))) for t, ks in sorted(labels.items())])
    firms = paid.select("candidate_id", F.explode(own).alias("label"), F.lit(2.5).alias("votes"))
    v = text.unionByName(firms).groupBy("candidate_id", "label").agg(F.sum("votes").alias("votes"))
    t = v.groupBy("candidate_id").agg(F.sum("votes").alias("total"), F.min_by(F.struct("label", "votes"), F.struct(-F.col("votes"), "label")).alias("b"))
    return t.select("candidate_id", "b.label", F.round(F.least(F.lit(0.92), 0.35 + 0.65 * F.col("b.votes") / F.col("total")), 3).alias("confidence"), (F.col("b.votes") < 2).alias("low_support"))


_RAISED = ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN {k} ELSE 0 END" for p, k in careers.TITLE_LEVELS)


@registry.query(
    f"""WITH {ROLES}, {PROFILES}, c AS (SELECT candidate_id, lower(trim(coalesce(title, ''))) AS t, coalesce(employer_tier, 'unknown') AS tier, title IS NOT NULL AS stated FROM roles WHERE NOT coalesce(is_internship, false)
        QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY coalesce(is_current, false) DESC, s DESC NULLS LAST, seq) = 1),
    l AS (SELECT *, CASE WHEN regexp_matches(t, '{careers._INTERN}') THEN 1 ELSE greatest(3, {_RAISED}) END AS k FROM c), r AS (SELECT *, CASE WHEN tier = 'regional_broker' AND k >= 4 THEN k - 1 ELSE k END AS level FROM l)
    SELECT candidate_id, CASE WHEN level <= 2 AND years_experience > 8 THEN level + 1 ELSE level END AS level, coalesce(level >= 6 AND years_experience < 5, false) AS tension, CASE WHEN stated THEN 0.85 ELSE 0.4 END::DOUBLE AS confidence FROM r LEFT JOIN profiles USING (candidate_id)"""
)
def seniority_person(spark, sf):
    """Level of a person by the title they hold: a junior title beside more than eight years counts one more."""
    w = Window.partitionBy("candidate_id").orderBy(F.coalesce("is_current", F.lit(False)).desc(), F.col("s").desc_nulls_last(), "seq")
    c = P.roles(spark, sf).where("not coalesce(is_internship, false)").withColumn("r", F.row_number().over(w)).where("r = 1")
    t = F.lower(F.trim(F.coalesce("title", F.lit(""))))
    k = F.when(F.regexp_like(t, F.lit(careers._INTERN)), 1).otherwise(F.greatest(F.lit(3), *[F.when(F.regexp_like(t, F.lit(p)), n).otherwise(0) for p, n in careers.TITLE_LEVELS]))
    c = c.select("candidate_id", F.coalesce("employer_tier", F.lit("unknown")).alias("tier"), F.col("title").isNotNull().alias("stated"), k.alias("k"))
    level = F.when(F.expr("tier = 'regional_broker' and k >= 4"), F.col("k") - 1).otherwise(F.col("k"))
    j = c.withColumn("level", level).join(P.profiles(spark, sf, "years_experience"), "candidate_id", "left")
    return j.select(
        "candidate_id", F.when(F.expr("level <= 2 and years_experience > 8"), F.col("level") + 1).otherwise(F.col("level")).alias("level"),
        F.coalesce(F.expr("level >= 6 and years_experience < 5"), F.lit(False)).alias("tension"), F.when(F.col("stated"), 0.85).otherwise(0.4).alias("confidence"),
    )


_BEST = "CASE " + " ".join(f"WHEN regexp_matches(t, {q(p)}) THEN '{k}'" for k, p in V.DEGREES) + " END"
_RANK = "CASE level " + " ".join(f"WHEN '{k}' THEN {r}" for k, r in V.DEGREE_RANK.items()) + " END"


@registry.query(
    f"""WITH t AS (SELECT candidate_id, chunk_id, {_LOW} AS t FROM chunks WHERE text IS NOT NULL), l AS (SELECT candidate_id, chunk_id, {_BEST} AS level FROM t), r AS (SELECT *, {_RANK} AS rank FROM l WHERE level IS NOT NULL)
    SELECT candidate_id, arg_max(level, (rank, level)) AS highest, count(DISTINCT chunk_id) AS chunks FROM r GROUP BY 1"""
)
def highest_degree(spark, sf):
    """The highest of six levels that a candidate's chunks of any kind name; of one rank the later label."""
    t = V.normalise(F.col("text"))
    level = let(t, lambda x: F.coalesce(*[F.when(F.regexp_like(x, F.lit(p)), F.lit(k)) for k, p in V.DEGREES]))
    rank = F.coalesce(*[F.when(F.col("level") == k, r) for k, r in V.DEGREE_RANK.items()])
    rows = load(spark, sf, "chunks").where("text is not null").select("candidate_id", "chunk_id", level.alias("level")).where("level is not null")
    return rows.groupBy("candidate_id").agg(F.max_by("level", F.struct(rank.alias("rank"), "level")).alias("highest"), F.countDistinct("chunk_id").alias("chunks"))


#: Words of titles and of organisations.
TITLE_WORDS = r"(?i)\b(analyst|associate|manager|director|intern|trainee|vice president|vp|president|officer|engineer|developer|strategist|consultant|researcher|partner|head|chief|specialist|assistant|representative)\b"
ORG_WORDS = r"(?i)(\b(inc|llc|ltd|limited|plc|pvt|corp|corporation|group|holdings?|partners?|capital|management|securities|bank|advisors?|associates|company|co|university|college|school|institute)\b|[A-Za-z0-9_]&[A-Za-z0-9_])"


@registry.query(
    f"""WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
    s AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, trim(line, ' ' || chr(9) || chr(13)) AS s FROM l), f AS (SELECT *, regexp_matches(s, {q(TITLE_WORDS)}) AS titled, regexp_matches(s, {q(ORG_WORDS)}) AS firm, len(regexp_extract_all(s, '[A-Z]')) > 0.75 * len(regexp_extract_all(s, '[A-Za-z]')) AS shouted FROM s WHERE s <> '' AND length(s) <= 90)
    SELECT doc_id, line_no, CASE WHEN firm THEN 'word' WHEN shouted THEN 'capitals' ELSE 'no title' END AS by FROM f WHERE firm OR NOT titled"""
)
def organisation_lines(spark, sf):
    """Lines that look like an employer: by a word of firms, by capitals, or by the absence of any word of titles."""
    from ..operators.texts import lines_with_offsets

    s = lines_with_offsets(load(spark, sf, "documents"), "doc_id", "text").select("doc_id", "line_no", F.trim("line", F.lit(" \t\r")).alias("s")).where("s <> '' and length(s) <= 90")
    like = lambda p: F.regexp_like("s", F.lit(p))
    shouted = F.regexp_count("s", F.lit("[A-Z]")) > 0.75 * F.regexp_count("s", F.lit("[A-Za-z]"))
    f = s.select("doc_id", "line_no", like(TITLE_WORDS).alias("titled"), like(ORG_WORDS).alias("firm"), shouted.alias("shouted"))
    return f.where("firm or not titled").select("doc_id", "line_no", F.when(F.col("firm"), "word").when(F.col("shouted"), "capitals").otherwise("no title").alias("by"))


# ------------------------------------------------------------------ labels by their triggers

_TRIGGERS = f"""{PROFILES}, {PARSED}, st AS (SELECT unnest(from_json(p -> '$.strategies', '["JSON"]')) AS x FROM parsed WHERE json_type(p -> '$.strategies') = 'ARRAY'),
    tr AS (SELECT x ->> '$.label' AS label, unnest(from_json(x -> '$.triggers', '["VARCHAR"]')) AS trigger FROM st WHERE json_type(x) = 'OBJECT' AND json_type(x -> '$.triggers') = 'ARRAY'),
    vocab AS (SELECT DISTINCT label, lower(trigger) AS trigger FROM tr WHERE label IS NOT NULL AND trigger IS NOT NULL)"""
_GRAMS = "list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))"


@registry.query(
    f"""WITH {_TRIGGERS}, t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}+#]+') AS w FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, unnest({_GRAMS}) AS trigger FROM t),
    h AS (SELECT doc_id, label, count(*) AS n FROM g JOIN vocab USING (trigger) GROUP BY 1, 2) SELECT doc_id, label, n, round(least(0.8, 0.35 + 0.15 * n), 4)::DOUBLE AS confidence, n < 2 AS low_support FROM h"""
)
def rule_labels(spark, sf):
    """Labels of each document by the triggers all profiles know, joined as groups of up to three words; surer the more there are."""
    text = F.get_json_object(P.profile_json(F.col("payload")), "$.strategies")
    items = F.from_json(F.when(F.startswith(text, F.lit("[")), text), "array<string>")
    x = P.profiles(spark, sf, "payload").select(F.explode(items).alias("x")).where(F.startswith("x", F.lit("{")))
    listed = F.from_json(F.get_json_object("x", "$.triggers"), "array<string>")
    vocab = x.select(F.get_json_object("x", "$.label").alias("label"), F.explode(listed).alias("t")).where("label is not null and t is not null").select("label", F.lower("t").alias("trigger")).distinct()
    w = F.col("w")
    upto = lambda n: F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
    joined = lambda n: (lambda i: F.array_join(F.slice(w, i, n), " "))
    words = F.regexp_extract_all(F.lower(F.replace("text", F.lit("İ"), F.lit("i"))), F.lit(r"[\p{L}\p{N}+#]+"), F.lit(0))
    g = load(spark, sf, "documents").where("text is not null").select("doc_id", words.alias("w")).select("doc_id", F.explode(F.concat(w, *[F.transform(upto(n), joined(n)) for n in (2, 3)])).alias("trigger"))
    h = g.join(vocab, "trigger").groupBy("doc_id", "label").agg(F.count("*").alias("n"))
    return h.select("doc_id", "label", "n", F.round(F.least(F.lit(0.8), 0.35 + 0.15 * F.col("n")), 4).alias("confidence"), (F.col("n") < 2).alias("low_support"))


#: Labels that are shown otherwise than their words.
SHOWN = {"emea": "Europe / EMEA", "apac": "Asia-Pacific", "americas": "Americas", "mbb": "MBB", "L1": "Level 1"}
_SHOW = "CASE " + " ".join(f"WHEN label = '{k}' THEN '{v}'" for k, v in SHOWN.items()) + " ELSE upper(substr(replace(label, '_', ' '), 1, 1)) || substr(replace(label, '_', ' '), 2) END"
_LABELLED = ("region", "seniority_level", "approach", "feeder_path")


@registry.query(f"WITH l AS ({' UNION '.join(f'SELECT {q(c)} AS dim, trim({c}) AS label FROM candidates WHERE {c} IS NOT NULL' for c in _LABELLED)}) SELECT dim, label, {_SHOW} AS shown FROM l")
def label_display(spark, sf):
    """How each label of the closed dimensions is shown: by the table, else by its words."""
    c = load(spark, sf, "candidates")
    rows = c.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.trim(d).alias("label")) for d in _LABELLED])).alias("x")).select("x.*").where("label is not null").distinct()
    words = F.replace("label", F.lit("_"), F.lit(" "))
    plain = F.concat(F.upper(F.substring(words, 1, 1)), F.expr("substring(replace(label, '_', ' '), 2)"))
    return rows.select("dim", "label", F.coalesce(*[F.when(F.col("label") == k, F.lit(v)) for k, v in SHOWN.items()], plain).alias("shown"))
