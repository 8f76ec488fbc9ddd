"""Loose date text to partial dates and month indexes; durations in text to months."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names by their first letters, in their order.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

#: What stands for an end that has not come yet.
PRESENT = "present|current|till date|till now|now|ongoing|today"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, with `value` computed once however often `body` names it.

    Catalyst inlines projections wherever a filter or aggregate reaches through them; a chain of
    patterns then outgrows what can be compiled. A lambda's variable is never inlined.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_date(raw: Column, century_pivot: int = 50, latest_year: int = 2027) -> Column:
    """`YYYY-MM`, `YYYY` or `present`; NULL for null, blank and unreadable text.

    Two-digit years below `century_pivot` are 20xx, others 19xx. The first of these forms
    found in the text counts: a present marker, `YYYY-MM`, a month name with a year,
    `M/YYYY`, a bare year.
    """
    names = "".join(f" {m}" for m in MONTHS)  # in the order of the months: a name's place gives its number
    named = rf"\b((?:{'|'.join(MONTHS)})[a-z]{{0,6}})[\s.\-']*'?([0-9]{{4}}|[0-9]{{2}})(?![0-9])"

    def with_year(number: Column, text: Column) -> Column:
        year = F.when(number < century_pivot, number + 2000).when(number < 100, number + 1900).otherwise(number)
        place = F.floor(F.instr(F.lit(names), F.substring(F.regexp_extract(text, named, 1), 1, 3)) / 4).cast("int") + 1
        return F.when(year.between(1950, latest_year), F.concat_ws("-", year, F.lpad(place.cast("string"), 2, "0")))

    def numeric(found: Column) -> Column:
        return F.when(
            F.contains(found, F.lit("/")),
            F.concat_ws("-", F.substring_index(found, "/", -1), F.lpad(F.substring_index(found, "/", 1), 2, "0")),
        ).when(found != "", found)

    def forms(text: Column) -> Column:
        iso = F.regexp_extract(text, r"\b(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])\b", 0)
        return F.when(F.regexp_like(text, F.lit(rf"\b(?:{PRESENT})\b")), F.lit("present")).otherwise(
            F.coalesce(
                let(iso, lambda x: F.when(x != "", x)),
                let(F.regexp_extract(text, named, 2).try_cast("int"), lambda x: with_year(x, text)),
                let(F.regexp_extract(text, r"\b(?:(?:0?[1-9]|1[0-2])/)?(?:19|20)[0-9]{2}\b", 0), numeric),
            )
        )

    return let(F.translate(F.lower(F.trim(raw)), "’‘", "''"), forms)


def month_index(parsed: Column, as_of: str) -> Column:
    """12·year + month of a parsed date; a bare year is its June, `present` is `as_of` (`YYYY-MM`)."""
    s = F.when(parsed == "present", F.lit(as_of)).otherwise(parsed)
    return F.substring(s, 1, 4).cast("int") * 12 + F.coalesce(F.substring(s, 6, 2).try_cast("int"), F.lit(6))


#: An end that has not come yet, where nothing else stands.
OPEN_END = ["present", "till date", "current"]


def read_month(raw: Column, as_of: str) -> Column:
    """Month index of a text that is a month or a year as a whole; NULL of anything else.

    Read are `YYYY-MM`, `M/YYYY`, a month's name or its beginning with a year of four or two digits
    (20xx), a bare year (its June), each after `since` or not, and OPEN_END (`as_of`), in any case.
    Months beyond 12, other orders and text beside a date make it unreadable.
    """
    name = "|".join(MONTHS)
    year = r"(?:19|20)[0-9]{2}"

    def forms(text: Column) -> Column:
        t = F.regexp_replace(text, r"^since ", "")
        named = rf"^({name})[a-z]{{0,6}}[ .\-']*({year}|[0-9]{{2}})$"
        digits = F.regexp_extract(t, named, 2)
        of_name = F.floor(F.instr(F.lit("".join(f" {m}" for m in MONTHS)), F.regexp_extract(t, named, 1)) / 4).cast("int") + 1
        full = F.when(F.length(digits) == 2, F.concat(F.lit("20"), digits)).otherwise(digits).try_cast("int")
        as_index = lambda y, m: y.try_cast("int") * 12 + m.try_cast("int")
        return (
            F.when(F.regexp_like(t, F.lit(rf"^{year}-(?:0[1-9]|1[0-2])$")), as_index(F.substring(t, 1, 4), F.substring(t, 6, 2)))
            .when(F.regexp_like(t, F.lit(rf"^(?:0?[1-9]|1[0-2])/{year}$")), as_index(F.substring_index(t, "/", -1), F.substring_index(t, "/", 1)))
            .when(F.regexp_like(t, F.lit(rf"^{year}$")), t.try_cast("int") * 12 + 6)
            .when(digits != "", full * 12 + of_name)
            .when(t.isin(OPEN_END), F.lit(int(as_of[:4]) * 12 + int(as_of[5:])))
        )

    return let(F.translate(F.lower(F.trim(F.regexp_replace(raw, r"\s+", " "))), "’‘", "''"), forms)


def month_label(index: Column) -> Column:
    """`YYYY-MM` of a month index, NULL of NULL; December stays in its own year."""
    zero = index - 1
    year, month = F.floor(zero / 12).cast("int").cast("string"), (zero % 12 + 1).cast("int").cast("string")
    return F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"))


def parse_duration(raw: Column) -> Column:
    """Months in text such as `8 years 10 months`; NULL where neither unit occurs."""
    t = F.lower(raw)
    years = F.regexp_extract(t, r"([0-9]+(?:\.[0-9]+)?)\s*(?:year|yr)", 1).try_cast("double")
    months = F.regexp_extract(t, r"([0-9]+)\s*(?:month|mo\b)", 1).try_cast("int")
    return F.when(
        years.isNotNull() | months.isNotNull(),
        F.round(F.coalesce(years, F.lit(0.0)) * 12 + F.coalesce(months, F.lit(0))).cast("int"),
    )
