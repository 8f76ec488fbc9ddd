"""Word lists of careers, and their places in a text. All lists are fixed values, stated as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import let
from .text import MARKED, PLAIN, normalise

#: Kinds of skills, with the words for each, separated by commas.
SKILLS = {
    "python": "python, python3, py, pandas, numpy, scipy",
    "cpp": "c++, cpp",
    "csharp": "c#, .net",
    "java": "java",
    "sql": "sql, t-sql, postgres, mysql",
    "kdb": "kdb, kdb+, kx, q language",
    "matlab": "matlab",
    "vba": "vba, excel with vba, advanced excel/vba",
    "mongodb": "mongodb, mongo, nosql",
    "machine_learning": "machine learning, ml, neural network, deep learning, gradient descent, random forest, xgboost",
    "time_series": "time series, arima, garch, signal research, stochastic calculus, monte carlo, probability theory",
    "statistics": "statistics, statistical analysis, hypothesis testing, econometrics, regression",
    "backtesting": "backtesting, backtest, backtester, performance attribution",
    "financial_modelling": "financial modeling, financial modelling, three-statement, three statement, 3-statement, dcf, lbo, comparable company, sum-of-the-parts, valuation model, operating model",
    "equity_research": "equity research, initiation report, coverage initiation, earnings estimates, sector thematic",
    "portfolio_construction": "position sizing, portfolio construction, risk exposures, hedging, factor attribution, risk-adjusted",
    "due_diligence": "due diligence, diligence, expert network, expert calls, channel checks, primary research",
    "alternative_data": "alternative data, alt data, alternative datasets, web scraping",
    "bloomberg": "bloomberg, bloomberg terminal, allq, runz",
    "factset": "factset",
    "capital_iq": "capital iq, s&p capital iq, capiq",
    "refinitiv": "reuters, refinitiv, eikon",
    "excel": "excel, microsoft office, ms office",
    "gis": "gis, satellite imagery, geospatial",
}
#: Words that are skills only near a word of skill lists.
STRICT_SKILLS = {"r_lang": "r", "wind_db": "wind, wind database"}
SKILL_CONTEXT = ["skill", "programming", "tool", "python", "habilidades", "competences", "competenze", "fahigkeiten"]
#: Skills that make a quantitative and a fundamental profile, and words of credit.
QUANTITATIVE = ["python", "cpp", "csharp", "r_lang", "kdb", "matlab", "machine_learning", "time_series", "statistics", "backtesting", "sql", "java"]
FUNDAMENTAL = ["financial_modelling", "equity_research", "due_diligence"]
CREDIT_WORDS = ["high yield", "investment grade", "credit", "bond", "securitization"]

#: Certificates with the words for each, and markers of how far they were taken.
CERTIFICATIONS = {
    "cfa": "cfa, chartered financial analyst",
    "frm": "frm, financial risk manager",
    "cpa": "cpa, certified public accountant",
    "caia": "caia",
    "series_7": "series 7",
    "series_63": "series 63",
    "series_87": "series 87",
    "mbbs": "mbbs, m.b.b.s",
}
CERTIFICATION_LEVELS = {"cfa": {"charterholder": "charterholder, charter holder, level iii, level 3, passed level iii", "level_ii": "level ii, level 2", "level_i": "level i, level 1"}}

#: Languages, and words for how well one is spoken, in the order in which they count.
LANGUAGES = "english, mandarin, cantonese, chinese, french, arabic, spanish, portuguese, german, japanese, hindi, marathi, italian, russian".split(", ")
PROFICIENCY = "native, fluent, professional, conversational, basic, working".split(", ")

#: Places by region and country; and those of the test tables.
PLACES = {
    ("americas", "United States"): "new york, ny, nyc, boston, chicago, san francisco, greenwich, connecticut, ct, cambridge ma, evanston, ann arbor, brooklyn, united states, usa, u.s., massachusetts, illinois, michigan, austin",
    ("americas", "Brazil"): "sao paulo, brazil",
    ("americas", "Canada"): "toronto, montreal, canada",
    ("emea", "United Kingdom"): "london, united kingdom, uk, england, leeds",
    ("emea", "France"): "paris, lyon, france",
    ("emea", "Morocco"): "casablanca, rabat, morocco",
    ("emea", "Germany"): "frankfurt, berlin, munich, germany, koln, leipzig",
    ("emea", "Switzerland"): "zurich, geneva, geneve, switzerland",
    ("emea", "UAE"): "dubai, abu dhabi, uae",
    ("emea", "Ireland"): "dublin, ireland",
    ("emea", "Portugal"): "lisbon, porto, portugal",
    ("emea", "Spain"): "malaga, valencia, spain",
    ("emea", "Italy"): "turin, trieste, italy",
    ("emea", "Poland"): "krakow, poland",
    ("apac", "Hong Kong"): "hong kong, hk",
    ("apac", "India"): "mumbai, noida, pune, navi mumbai, bangalore, bengaluru, delhi, gurgaon, india, maharashtra",
    ("apac", "Singapore"): "singapore",
    ("apac", "China"): "shanghai, beijing, shenzhen, jiangxi, china, greater china",
    ("apac", "Japan"): "tokyo, osaka, japan",
    ("apac", "Australia"): "sydney, melbourne, australia",
}

#: Ways into the trade: words that speak for each, and kinds of firms.
FEEDERS = {
    "ibd_analyst_program": ("investment banking, ibd, m&a, leveraged finance, coverage group, summer analyst, analyst class", "bulge_bracket, elite_boutique"),
    "sellside_research": ("equity research, sell-side, sell side, initiation, institutional investor, coverage of, under coverage, brokerage", "bulge_bracket, elite_boutique, regional_broker"),
    "buyside_lateral": ("portfolio manager, long/short, pod, book, pnl, p&l, sizing", "pod_shop, hedge_fund_other, long_only"),
    "quant_technical": ("quantitative developer, quantitative strategist, pricing library, c++, phd, stochastic, engineering, msc, financial engineering", "bulge_bracket, quant_fund"),
    "consulting": ("consultant, business analyst, engagement, client team, case competition", "mbb"),
    "accounting_ta": ("transaction services, transaction advisory, audit, cdts, valuation services", "big_four"),
    "private_markets": ("private equity, growth equity, portfolio company, board observer, buyout", "hedge_fund_other"),
    "industry_domain": ("mbbs, md , physician, biotech, laboratory, clinical, engineer at, biomodeller, research associate", ""),
}

#: Degrees by level, the first pattern that matches counts; and the rank of each level.
DEGREES = [
    ("phd", r"\b(ph\.?d|doctor of philosophy|dphil)\b"),
    ("mba", r"\b(m\.?b\.?a|master of business administration|pgdm|pgp)\b"),
    ("professional", r"\b(m\.?b\.?b\.?s|m\.?d\b|doctor of medicine)\b"),
    ("masters", r"\b(m\.?s\.?c?|master(?:'s)? (?:of|in|degree)|m\.?tech|m\.?com|masters?|diplome d'ingenieur|mfe)\b"),
    ("bachelors", r"\b(b\.?s\.?c?|b\.?a\b|bachelor|b\.?tech|b\.?com|b\.?m\.?s|bba)\b"),
    ("secondary", r"\b(xii std|x std|hsc|ssc|high school|secondary|preparatory class)\b"),
]
DEGREE_RANK = {"phd": 5, "mba": 4, "professional": 4, "masters": 3, "bachelors": 2, "secondary": 1}

_OUTSIDE = r"[^\p{L}\p{N}_+#.&]+"
_POINTS = r"\.+( |$)"


def listed(words: str) -> list[str]:
    """The words of a list, as they stand in a spaced text."""
    out = []
    for w in words.split(", "):
        t = "".join(c if c.isalnum() or c in "_+#.&" else " " for c in w.lower())
        parts = [p.rstrip(".") for p in t.split()]
        out.append(" ".join(p for p in parts if p))
    return sorted({w for w in out if w})


def spaced(text: Column) -> Column:
    """The normalised text as words of letters, digits, `+`, `#`, `&` and inner points, a blank around each."""
    return F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(normalise(text), _OUTSIDE, " "), _POINTS, " "), F.lit(" "))


def spaced_sql(text: str) -> str:
    """The same in DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    n = f"trim(regexp_replace(translate(lower(translate({text}, 'İ', 'I')), {quote(MARKED)}, {quote(PLAIN)}), '[ \\t\\n\\f\\r]+', ' ', 'g'))"
    return f"(' ' || regexp_replace(regexp_replace({n}, {quote(_OUTSIDE)}, ' ', 'g'), {quote(_POINTS)}, ' ', 'g') || ' ')"


def word_hits(text: Column, vocabulary: dict[str, str]) -> Column:
    """Array of (`label`, `word`, `spot`, `hits`) of the words that occur in a spaced text: the place of the first
    (code points of the spaced text, from 0) and their number."""

    known = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(w).alias("word"), F.lit(f" {w} ").alias("mark")) for label, words in vocabulary.items() for w in listed(words)])

    def of(n: Column) -> Column:
        def hit(x: Column) -> Column:
            # two blanks, so that neighbours do not share one
            wide, mark = F.replace(n, F.lit(" "), F.lit("  ")), F.concat(F.lit(" "), F.replace(x["word"], F.lit(" "), F.lit("  ")), F.lit(" "))
            count = ((F.length(wide) - F.length(F.replace(wide, mark, F.lit("")))) / F.length(mark)).cast("int")
            return F.struct(x["label"].alias("label"), x["word"].alias("word"), F.instr(n, x["mark"]).alias("spot"), count.alias("hits"))

        # the list is a constant; only words that occur are counted
        return F.transform(F.filter(known, lambda x: F.contains(n, x["mark"])), hit)

    return let(text, of)


def word_hits_sql(column: str, vocabulary: dict[str, str]) -> str:
    """The same as a DuckDB list of structs over a column that holds the spaced text."""
    rows = []
    for label, words in vocabulary.items():
        for w in listed(words):
            own = w.replace(" ", "  ").replace("'", "''")
            w = w.replace("'", "''")
            rows.append(f"{{'label': '{label}', 'word': '{w}', 'spot': instr({column}, ' {w} '), 'hits': CAST((length(replace({column}, ' ', '  ')) - length(replace(replace({column}, ' ', '  '), ' {own} ', ''))) // {len(own) + 2} AS INT)}}")
    return f"list_filter([{', '.join(rows)}], lambda x: x['spot'] > 0)"
