"""Decomposed scores of gated candidates, and what-ifs as rows of scenarios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .gating import Request, gate, lowered

LISTS = ["skills", "strategies", "regions", "approaches"]


@dataclass(frozen=True)
class Weights:
    """Default weights of the components; they are normalised to sum to one."""

    skills: float = 0.30
    strategies: float = 0.20
    regions: float = 0.15
    approaches: float = 0.15
    experience: float = 0.10
    quality: float = 0.10

    def normalised(self) -> dict[str, float]:
        total = sum(asdict(self).values()) or 1.0
        return {k: round(v / total, 6) for k, v in asdict(self).items()}


def components(view: DataFrame, request: Request) -> DataFrame:
    """`c_*` of each row: the share of what is wanted, 0.5 where nothing is; a band for years, 0.4 unknown."""
    out = {}
    for column in LISTS:
        wanted = [w.lower() for w in request.wanted(column)]
        if wanted:
            met = F.size(F.array_intersect(F.array(*map(F.lit, wanted)), lowered(column)))
            out[f"c_{column}"] = met / len(wanted)
        else:
            out[f"c_{column}"] = F.lit(0.5)
    lo, hi = float(request.min_years or 0), float(request.max_years or 99)
    y = F.col("years")
    if request.min_years is None and request.max_years is None:
        out["c_experience"] = F.lit(0.5)
    else:
        out["c_experience"] = (
            F.when(y.isNull(), 0.4).when(y.between(lo, hi), 1.0).when(y < lo, F.greatest(F.lit(0.0), 1 - (lo - y) / max(lo, 1.0))).otherwise(F.greatest(F.lit(0.35), 1 - (y - hi) / 20))
        )
    out["c_quality"] = F.col("quality")
    return view.select("candidate_id", *[c.alias(k) for k, c in out.items()])


def score(view: DataFrame, request: Request, weights: Weights) -> DataFrame:
    """The components and their weighted `total`, rounded to 4 digits."""
    total = sum((F.lit(v) * F.col(f"c_{k}") for k, v in weights.normalised().items()), F.lit(0.0))
    return components(view, request).withColumn("total", F.round(total, 4))


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The `k` best: a top-k first, so that only they are numbered in one task."""
    best = scored.select("candidate_id", "total").orderBy(F.desc("total"), "candidate_id").limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "candidate_id")))


def gaps(view: DataFrame, request: Request) -> DataFrame:
    """(`candidate_id`, `dim`, `item`, `verdict`): has, lacks, or unknown where nothing is stated."""
    out = None
    for column in LISTS:
        wanted = [w.lower() for w in request.wanted(column)]
        if not wanted:
            continue
        rows = view.select("candidate_id", F.lit(column).alias("dim"), lowered(column).alias("have"), F.explode(F.array(*map(F.lit, wanted))).alias("item"))
        verdict = F.when(F.array_contains("have", F.col("item")), "has").when(F.size("have") == 0, "unknown").otherwise("lacks")
        part = rows.select("candidate_id", "dim", "item", verdict.alias("verdict"))
        out = part if out is None else out.unionByName(part)
    return out


def scenarios(weights: Weights, delta: float = 0.10) -> Iterator[tuple[str, Weights]]:
    for name, value in asdict(weights).items():
        for sign, mark in ((1, "+"), (-1, "-")):
            yield f"{name}{mark}", replace(weights, **{name: max(0.0, value + sign * delta)})


def _places(scored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Place of the few `wanted` ids within each scenario: how many rows stand before them, counted in
    parallel, instead of numbering whole scenarios in one task each."""
    mine = scored.join(F.broadcast(wanted.select("candidate_id")), "candidate_id").select("scenario", F.col("candidate_id").alias("own"), F.col("total").alias("own_total"))
    before = scored.join(F.broadcast(mine), "scenario").where((F.col("total") > F.col("own_total")) | ((F.col("total") == F.col("own_total")) & (F.col("candidate_id") <= F.col("own"))))
    return before.groupBy("scenario", "own").agg(F.count("*").alias("n")).select("scenario", F.col("own").alias("candidate_id"), "n")


def sensitivity(comps: DataFrame, weights: Weights, delta: float = 0.10, top: int = 10) -> DataFrame:
    """How far the `top` best move when each weight is raised and lowered: scenarios are rows, not a loop.

    Each row gives one row a scenario. Only the `top` are broadcast.
    """
    weighed = [
        F.struct(F.lit(n).alias("scenario"), F.round(sum((F.lit(v) * F.col(f"c_{k}") for k, v in w.normalised().items()), F.lit(0.0)), 4).alias("total"))
        for n, w in scenarios(weights, delta)
    ]
    scored = comps.select("candidate_id", F.explode(F.array(*weighed)).alias("x")).select("x.scenario", "candidate_id", "x.total")
    base_total = F.round(sum((F.lit(v) * F.col(f"c_{k}") for k, v in weights.normalised().items()), F.lit(0.0)), 4)
    base = ranked(comps.select("candidate_id", base_total.alias("total")), top).select("candidate_id", F.col("place").alias("base_rank"))
    shift = F.abs(F.col("n") - F.col("base_rank"))
    moved = _places(scored, base).join(F.broadcast(base), "candidate_id").groupBy("candidate_id", "base_rank").agg(F.max(shift).cast("int").alias("max_rank_shift"), F.round(F.avg(shift), 2).alias("mean_abs_shift"))
    return moved.withColumn("verdict", F.when(F.col("max_rank_shift") <= 1, "robust").when(F.col("max_rank_shift") <= 3, "sensitive").otherwise("unstable"))


def edits(request: Request) -> Iterator[tuple[str, Request]]:
    """Every removal of a single requirement."""
    for block in ("must", "prefer", "exclude"):
        for column, values in getattr(request, block).items():
            for v in values:
                rest = [x for x in values if x != v]
                changed = {**getattr(request, block), column: rest}
                yield f"drop {block} {column} {v}", replace(request, **{block: {k: x for k, x in changed.items() if x}})
    if request.min_years is not None:
        yield "drop min_years", replace(request, min_years=None)


def minimal_edit(view: DataFrame, request: Request, weights: Weights, place: int) -> DataFrame:
    """The single removals that lift the candidate at `place`, with the place each leads to."""
    base = ranked(score(gate(view, request).where("kept"), request, weights), place).where(F.col("place") == place).select("candidate_id", F.col("place").alias("from_rank"))
    scored = None
    for name, changed in edits(request):
        part = score(gate(view, changed).where("kept"), changed, weights).select(F.lit(name).alias("scenario"), "candidate_id", "total")
        scored = part if scored is None else scored.unionByName(part)
    found = _places(scored, base).join(F.broadcast(base), "candidate_id").where("n < from_rank")
    return found.select(F.col("scenario").alias("edit"), "from_rank", F.col("n").cast("int").alias("new_rank"))
