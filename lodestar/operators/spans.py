"""Quotes located in their sources: exact, then folded, then by partial alignment; else abstained."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.92
#: What a claim's confidence loses by the rung its quote was found on.
LOSS = {"exact": 0.0, "normalized": 0.03, "fuzzy": 0.12}


def exact_spans(df: DataFrame, quote: str, text: str) -> DataFrame:
    """Adds `char_start`, `char_end`: the first verbatim place of the quote in the text, NULL without one or under three characters."""
    at = F.when(F.length(F.trim(quote)) >= 3, F.instr(F.col(text), F.col(quote)))
    start = F.when(at > 0, at - 1)
    return df.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length(quote))


def fold_with_map(text: str) -> tuple[str, list[int]]:
    """Lower case without marks and punctuation, blanks squeezed, and the source's place of every character."""
    out: list[str] = []
    where: list[int] = []
    for i, c in enumerate(text):
        for d in unicodedata.normalize("NFKD", c):
            if unicodedata.combining(d):
                continue
            d = d.lower() if d.isalnum() else " "
            if d == " " and (not out or out[-1] == " "):
                continue
            for e in d:
                out.append(e)
                where.append(i)
    while out and out[-1] == " ":
        out.pop()
        where.pop()
    return "".join(out), where


def align(needle: str, hay: str) -> tuple[float, int, int]:
    """(share, start, end) of the part of `hay` that `needle` aligns with best: one less the edits by length,
    by dynamic programming over free ends."""
    m = len(needle)
    cost, begin = [0] * (len(hay) + 1), list(range(len(hay) + 1))
    for i in range(1, m + 1):
        new_cost, new_begin = [i], [0]
        for j in range(1, len(hay) + 1):
            options = (
                (cost[j - 1] + (needle[i - 1] != hay[j - 1]), begin[j - 1]),
                (cost[j] + 1, begin[j]),
                (new_cost[j - 1] + 1, new_begin[j - 1]),
            )
            c, b = min(options)
            new_cost.append(c)
            new_begin.append(b)
        cost, begin = new_cost, new_begin
    end = min(range(len(cost)), key=lambda j: (cost[j], j))
    return 1 - cost[end] / max(1, m), begin[end], end


def likely(needle: str, hay: str, most: int) -> list[tuple[int, int]]:
    """Stretches of `hay`, merged, that hold every part within `most` edits of `needle`.

    Of `most` + 1 pieces of the needle one at least stands unchanged in such a part, so only the
    neighbourhoods of pieces are kept; nothing that can reach the threshold is lost.
    """
    m = len(needle)
    cuts = [m * i // (most + 1) for i in range(most + 2)]
    found = []
    for a, b in zip(cuts, cuts[1:]):
        at = hay.find(needle[a:b])
        while at >= 0:
            found.append((max(0, at - a - most), min(len(hay), at - a + m + most)))
            at = hay.find(needle[a:b], at + 1)
    merged: list[tuple[int, int]] = []
    for lo, hi in sorted(found):
        if merged and lo <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
        else:
            merged.append((lo, hi))
    return merged


def locate(quote: str | None, text: str | None, threshold: float = THRESHOLD) -> tuple[str, float, int | None, int | None]:
    """(kind, score, start, end): folded, fuzzy or none."""
    if not quote or not text or len(quote.strip()) < 3:
        return "none", 0.0, None, None
    q, (t, where) = fold_with_map(quote)[0], fold_with_map(text)
    if not q:
        return "none", 0.0, None, None
    at = t.find(q)
    if at >= 0:
        return "normalized", 1.0, where[at], where[at + len(q) - 1] + 1
    most = int((1 - threshold) * len(q) + 1e-9)
    tried = [(share, -(lo + b), lo + a, lo + b) for lo, hi in (likely(q, t, most) if most else ()) for share, a, b in [align(q, t[lo:hi])]]
    share, _, a, b = max(tried, default=(0.0, 0, 0, 0))  # the first of equal ones
    if share >= threshold and b > a:
        return "fuzzy", round(share, 4), where[a], where[b - 1] + 1
    return "none", 0.0, None, None


def span_ladder(df: DataFrame, keys: list[str], quote: str, text: str) -> DataFrame:
    """(`keys`, `kind`, `match_score`, `char_start`, `char_end`, `loss`): exact spans natively; only what is left reaches
    Python. `loss` is what the claim's confidence loses, NULL where it is to be dropped.

    A quote that is nowhere in its text is kind none with NULL offsets: the claim is to be dropped.
    """
    tried = exact_spans(df.select(*keys, F.col(quote).alias("q"), F.col(text).alias("t")), "q", "t")
    found = tried.where("char_start is not null").select(*keys, F.lit("exact").alias("kind"), F.lit(1.0).alias("match_score"), "char_start", "char_end")
    left = tried.where("char_start is null").select(*keys, "q", "t")
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [locate(q, t) for q, t in zip(f["q"], f["t"])]
            out = f[keys].copy()
            out["kind"], out["match_score"] = [r[0] for r in rows], [r[1] for r in rows]
            for n, name in ((2, "char_start"), (3, "char_end")):
                out[name] = pd.array([r[n] for r in rows], dtype="Int32")
            yield out

    both = found.unionByName(left.mapInPandas(run, f"{kinds}, kind string, match_score double, char_start int, char_end int"))
    return both.withColumn("loss", F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in LOSS.items()]))
