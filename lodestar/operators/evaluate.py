"""Ranking, set and calibration metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ndcg_mrr(hits: DataFrame, gain: Column, ideal: DataFrame, k: int = 10) -> DataFrame:
    """(`query`, `ndcg`, `mrr`) of rankings with a `place`; `ideal`: (`query`, `idcg`)."""
    g = hits.where(F.col("place") <= k).withColumn("g", gain)
    per = g.groupBy("query").agg(F.sum(F.col("g") / F.log2(F.col("place") + 1)).alias("dcg"), F.min(F.when(F.col("g") > 0, F.col("place"))).alias("first"))
    return per.join(ideal, "query").select(
        "query", F.round(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0), 4).alias("ndcg"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 4).alias("mrr")
    )


def set_scores(predicted: Column, gold: Column) -> dict[str, Column]:
    """Precision, recall and F1 of two sets; two empty sets are a full match."""
    hit, p, g = F.size(F.array_intersect(predicted, gold)), F.size(predicted), F.size(gold)
    both = (p == 0) & (g == 0)
    share = lambda n: F.when(both, 1.0).when(n == 0, 0.0).otherwise(hit / n)
    return {
        "precision": F.round(share(p), 4),
        "recall": F.round(share(g), 4),
        "f1": F.round(F.when(both, 1.0).when(hit == 0, 0.0).otherwise(2 * hit / (p + g)), 4),
    }


def calibration(df: DataFrame, confidence: str, correct: str, bins: int = 5) -> DataFrame:
    """(`bin`, `n`, `mean_confidence`, `accuracy`, `brier`) over equal bins of the observed range; empty ones are absent."""
    lo, hi = df.agg(F.min(confidence), F.max(confidence)).first()  # two numbers
    if lo is None:
        lo = hi = 0.0
    width = (hi - lo) / bins or 1.0
    bin_of = F.least(F.lit(bins - 1), F.floor((F.col(confidence) - lo) / width).cast("int"))
    return df.where(F.col(confidence).isNotNull()).groupBy(bin_of.alias("bin")).agg(
        F.count("*").alias("n"), F.round(F.avg(confidence), 4).alias("mean_confidence"), F.round(F.avg(correct), 4).alias("accuracy"), F.round(F.avg(F.pow(F.col(confidence) - F.col(correct), 2)), 4).alias("brier")
    )


def expected_error(df: DataFrame, confidence: str, correct: str, bins: int = 5) -> DataFrame:
    """One row: `n`, `ece` and `brier` over equal bins of the observed range; NULLs where nothing has a confidence."""
    lo, hi = df.agg(F.min(confidence), F.max(confidence)).first()  # two numbers
    lo, hi = (0.0, 0.0) if lo is None else (lo, hi)
    width = (hi - lo) / bins or 1.0
    bin_of = F.least(F.lit(bins - 1), F.floor((F.col(confidence) - lo) / width).cast("int"))
    per = df.where(F.col(confidence).isNotNull()).groupBy(bin_of.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(correct).alias("y"), F.sum(F.pow(F.col(confidence) - F.col(correct), 2)).alias("sq")
    )
    total = F.sum("n")
    return per.agg(total.alias("n"), F.round(F.sum(F.col("n") * F.abs(F.col("y") - F.col("c"))) / total, 4).alias("ece"), F.round(F.sum("sq") / total, 4).alias("brier"))


def nearest_rank(df: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """Percentiles by the element at round((n - 1) · share), not interpolated; values are counted first, so
    no group is collected."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("k"))
    w = Window.partitionBy(group)
    ranked = counts.withColumns({"upto": F.sum("k").over(w.orderBy(value)), "total": F.sum("k").over(w)})
    picks = [F.min(F.when(F.col("upto") > F.round((F.col("total") - 1) * F.lit(s)), F.col(value))).alias(f"p{round(s * 100)}") for s in shares]
    return ranked.groupBy(group).agg(F.max("total").alias("n"), *picks)
