"""Free-text requests read into a `Request`, on the driver: they are one sentence, not data."""

from __future__ import annotations

import json
import re
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.gating import Request

#: Words that make a clause a requirement, a preference, and words that negate what follows.
MUST_WORDS = ["must", "required", "require", "mandatory", "essential", "minimum", "at least", "only consider", "strictly"]
PREFER_WORDS = ["prefer", "preferred", "preferable", "nice to have", "a plus", "bonus", "ideally", "desirable", "would be good", "open to"]
NEGATING_WORDS = ["no", "not", "without", "exclude", "excluding", "avoid", "non"]
#: Words before the least and the most years, and after a number of years.
LEAST_WORDS = ["at least", "minimum", "min", "min.", "over", "more than"]
MOST_WORDS = ["at most", "maximum", "max", "max.", "under", "less than", "up to", "below"]
YEAR_WORDS = ["years", "year", "yrs", "yr", "y"]


def any_of(words: list[str]) -> str:
    """A pattern of one of the words, whole, the longest first."""
    return r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + r")(?!\w)"


MUST, PREFER = any_of(MUST_WORDS), any_of(PREFER_WORDS)
NEGATION = any_of(NEGATING_WORDS) + r"[\s\-]*([a-z+#/&' _]{3,40})"
_NUMBER = r"(\d+(?:\.\d+)?)"
_YEARS = rf"\s*\+?\s*(?:{'|'.join(YEAR_WORDS)})(?!\w)"


def clauses(text: str) -> list[str]:
    """Sentences, lines and list items; a point between digits ends none."""
    return [c.strip() for c in re.split(r"(?<!\d)\.|\.(?!\d)|[;\n\r]+|\s+[-•*]\s+", text) if len(c.strip()) >= 3]


def hits(text: str, vocabulary: dict[str, dict[str, list[str]]]) -> dict[str, list[str]]:
    """Labels of each list whose alias stands in the text in whole words."""
    low = text.lower()
    stands = lambda a: re.search(rf"(?<![\w+#]){re.escape(a.lower())}(?![\w+#])", low)
    found = {column: sorted(label for label, aliases in labels.items() if any(map(stands, aliases))) for column, labels in vocabulary.items()}
    return {k: v for k, v in found.items() if v}


def years(clause: str) -> tuple[float | None, float | None]:
    """(least, most) years that a clause names; both kinds of dash stand in a range."""
    low = clause.lower()
    if m := re.search(rf"{_NUMBER}\s*(?:-|–|to)\s*{_NUMBER}{_YEARS}", low):
        return float(m[1]), float(m[2])
    if m := re.search(rf"{any_of(MOST_WORDS)}\s*{_NUMBER}", low):
        return None, float(m[1])
    if m := re.search(rf"{any_of(LEAST_WORDS)}\s*{_NUMBER}", low) or re.search(_NUMBER + _YEARS, low):
        return float(m[1]), None
    return None, None


def parse(text: str, vocabulary: dict[str, dict[str, list[str]]]) -> Request:
    """Negations come first and leave the text; each clause is then a requirement only if it says so
    and names no preference. What is excluded is wanted nowhere, and a requirement is no preference."""
    exclude: dict[str, set] = {}

    def negated(m: re.Match) -> str:
        for column, labels in hits(m[1], vocabulary).items():
            exclude.setdefault(column, set()).update(labels)
        return " "

    rest = re.sub(NEGATION, negated, text, flags=re.I)
    blocks: tuple[dict[str, set], dict[str, set]] = ({}, {})
    least = most = None
    for clause in clauses(rest):
        hard = bool(re.search(MUST, clause, re.I)) and not re.search(PREFER, clause, re.I)
        for column, labels in hits(clause, vocabulary).items():
            blocks[0 if hard else 1].setdefault(column, set()).update(labels)
        lo, hi = years(clause)
        if hard:
            least, most = lo if lo is not None else least, hi if hi is not None else most
    must = {k: sorted(v - exclude.get(k, set())) for k, v in blocks[0].items()}
    prefer = {k: sorted(v - exclude.get(k, set()) - blocks[0].get(k, set())) for k, v in blocks[1].items()}
    some = lambda d: {k: list(v) for k, v in d.items() if v}
    return Request(some(must), some(prefer), {k: sorted(v) for k, v in exclude.items()}, least, most)


def moved(request: Request, column: str, value: str, to: str) -> Request:
    """The request with one value as a requirement (`must`) or a preference (`prefer`)."""
    other = "prefer" if to == "must" else "must"
    without = lambda d: {k: [x for x in v if not (k == column and x == value)] for k, v in d.items()}
    source, target = without(getattr(request, other)), without(getattr(request, to))
    target[column] = sorted({*target.get(column, []), value})
    return replace(request, **{other: {k: v for k, v in source.items() if v}, to: target})


def restored(template: str | None) -> Request:
    """A request out of a stored template; what is missing or broken is empty."""
    try:
        data = json.loads(template or "{}")
    except ValueError:
        data = {}
    lists = lambda x: {str(k): [str(y) for y in v] for k, v in x.items() if isinstance(v, list)} if isinstance(x, dict) else {}
    number = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
    data = data if isinstance(data, dict) else {}
    return Request(lists(data.get("must")), lists(data.get("prefer")), lists(data.get("exclude")), number(data.get("min_years")), number(data.get("max_years")))


def match_expression(query: str) -> str:
    """Terms of more than one character, at most 32, quoted and joined by OR, for a full-text engine."""
    words = [w for w in re.sub(r"[^\w\s+#.-]", " ", query or "").split() if len(w) > 1]
    return " OR ".join(f'"{w}"' for w in words[:32])


def tolerant_json(text: Column) -> Column:
    """The JSON in a text that may wrap it: inside a fence, whole, or from the first to the last brace or bracket; else NULL."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.regexp_replace(F.when(fenced != "", fenced).otherwise(text), r"^\s+|\s+$", "")
    pick = lambda pattern: F.regexp_extract(body, pattern, 0)
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull() & (c != ""), c)
    return F.coalesce(valid(body), valid(pick(r"(?s)\{.*\}")), valid(pick(r"(?s)\[.*\]")))
