"""Three-valued gating: unknown never eliminates, preference never eliminates, every exclusion has its reasons."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import profiles as P


@dataclass(frozen=True)
class Request:
    """What is required, preferred and excluded, by list column of the scorable view."""

    must: dict[str, list[str]] = field(default_factory=dict)
    prefer: dict[str, list[str]] = field(default_factory=dict)
    exclude: dict[str, list[str]] = field(default_factory=dict)
    min_years: float | None = None
    max_years: float | None = None
    min_level: int | None = None

    def wanted(self, column: str) -> list[str]:
        return sorted({*self.must.get(column, []), *self.prefer.get(column, [])})


def scorable(spark: SparkSession, sf: str) -> DataFrame:
    """The only columns a gate or scorer reads; an unknown list is empty, an unknown number NULL."""
    listed = lambda df, c, name: df.groupBy("candidate_id").agg(F.array_sort(F.collect_set(c)).alias(name))
    p = P.profiles(spark, sf, *[c for c in P.SCORABLE if c != "candidate_id"])
    p = p.join(listed(P.skills(spark, sf), "skill", "skills"), "candidate_id", "left").join(listed(P.strategies(spark, sf), "strategy", "strategies"), "candidate_id", "left")
    empty = F.array().cast("array<string>")
    return p.select(
        "candidate_id",
        F.coalesce("skills", empty).alias("skills"),
        F.coalesce("strategies", empty).alias("strategies"),
        F.when(F.col("region").isNull() | (F.col("region") == "unknown"), empty).otherwise(F.array("region")).alias("regions"),
        F.when(F.col("approach").isNull(), empty).otherwise(F.array("approach")).alias("approaches"),
        F.col("years_experience").alias("years"),
        F.col("completeness").alias("quality"),
    )


def lowered(column: str) -> Column:
    return F.transform(column, lambda x: F.lower(x))


def has_any(column: str, values: list[str]) -> Column:
    """Whether lists share an element, case ignored; elements that are NULL never match."""
    return F.arrays_overlap(F.filter(lowered(column), lambda x: x.isNotNull()), F.array(*[F.lit(v.lower()) for v in values]))


def _among(values: list[str]):
    lower = [v.lower() for v in values]
    return lambda x: F.lower(x).isin(lower)


def gate(view: DataFrame, request: Request) -> DataFrame:
    """Adds `reasons`, `caveats` and `kept`.

    A requirement unmet by known values is a reason; unmet as nothing is known, a caveat. Rows with a
    reason are not kept, but stay in the result.
    """
    reasons, caveats = [], []
    for column, values in request.must.items():
        shown = ", ".join(values)
        known = F.size(column) > 0
        reasons.append(F.when(known & ~has_any(column, values), F.concat(F.lit(f"must-have {column}: {shown} (has "), F.array_join(F.slice(column, 1, 4), ", "), F.lit(")"))))
        caveats.append(F.when(~known, F.lit(f"{column} not stated, {shown} not confirmed")))
    for column, values in request.exclude.items():
        hit = F.filter(column, _among(values))
        reasons.append(F.when(has_any(column, values), F.concat(F.lit(f"excluded {column}: "), F.array_join(hit, ", "))))
    if request.min_years is not None:
        reasons.append(F.when(F.col("years") < request.min_years, F.lit(f"years below {request.min_years:g}")))
        caveats.append(F.when(F.col("years").isNull(), F.lit(f"years unknown, minimum {request.min_years:g} not confirmed")))
    if request.max_years is not None:
        reasons.append(F.when(F.col("years") > request.max_years, F.lit(f"years above {request.max_years:g}")))
    if request.min_level is not None:
        reasons.append(F.when(F.col("level") < request.min_level, F.concat(F.lit("level "), F.col("level").cast("string"), F.lit(f" below {request.min_level}"))))
        caveats.append(F.when(F.col("level").isNull(), F.lit(f"level unknown, minimum {request.min_level} not confirmed")))
    listed = lambda cs: F.array_compact(F.array(*cs)) if cs else F.array().cast("array<string>")
    out = view.withColumns({"reasons": listed(reasons), "caveats": listed(caveats)})
    return out.withColumn("kept", F.size("reasons") == 0)


def filter_rail(df: DataFrame, facets: dict[str, list[str]], years: tuple[float, float] | None = None, include_unknown_years: bool = False, min_completeness: float | None = None) -> DataFrame:
    """OR within a facet, AND across; an empty selection is no opinion. All conditions reach the scan."""
    for column, values in facets.items():
        if values:
            df = df.where(F.col(column).isin(values))
    if years:
        inside = F.col("years_experience").between(*years)
        df = df.where(inside | F.col("years_experience").isNull() if include_unknown_years else inside)
    if min_completeness is not None:
        df = df.where(F.col("completeness") >= min_completeness)
    return df
