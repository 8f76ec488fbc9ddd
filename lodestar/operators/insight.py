"""Pool analytics: facets, co-occurrence, coverage, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import profiles as P


def experience_band(years: Column) -> Column:
    return (
        F.when(years.isNull(), "unknown").when(years < 2, "<2").when(years < 5, "2-5").when(years < 8, "5-8").when(years < 12, "8-12").otherwise("12+")
    )


def facets(spark: SparkSession, sf: str) -> DataFrame:
    """(`dim`, `value`, `candidate_id`) of every occurrence: two roles at one firm count twice."""
    p = P.profiles(spark, sf, "region", "country", "seniority_level", "approach", "feeder_path", "years_experience")
    one = lambda dim, value, df=p: df.select(F.lit(dim).alias("dim"), value.alias("value"), "candidate_id").where("value is not null")
    parts = [one(c, F.col(c)) for c in ("region", "country", "seniority_level", "approach", "feeder_path")]
    parts.append(one("experience_band", experience_band(F.col("years_experience"))))
    s = P.skills(spark, sf)
    parts += [one("skill", F.col("skill"), s), one("skill_deep", F.col("skill"), s.where("depth in ('core', 'applied')"))]
    parts.append(one("strategy", F.col("strategy"), P.strategies(spark, sf)))
    r = P.roles(spark, sf)
    parts += [one("employer", F.col("employer_canonical"), r), one("employer_tier", F.col("employer_tier"), r)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def distributions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dim", "value").agg(F.count("*").alias("n"))


def co_occurrence(pairs: DataFrame, item: str, least: int = 2, top: int = 40) -> DataFrame:
    """The `top` most frequent unordered pairs of a candidate's items, then those that occur `least` times or more."""
    a, b = (pairs.select("candidate_id", F.col(item).alias(x)) for x in "ab")
    counts = a.join(b, "candidate_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "a", "b").limit(top).where(F.col("n") >= least)


def coverage_gaps(counts: DataFrame, vocabulary: DataFrame, thin: int = 2) -> DataFrame:
    """Values of the vocabulary that `thin` candidates or fewer have: severity none without any, else thin."""
    n = F.coalesce("n", F.lit(0))
    return vocabulary.join(counts, ["dim", "value"], "left").select("dim", "value", n.alias("n")).where(F.col("n") <= thin).withColumn("severity", F.when(F.col("n") == 0, "none").otherwise("thin"))


def top_values(counts: DataFrame, k: int) -> DataFrame:
    """The `k` most frequent values of each dimension, ties by value."""
    w = Window.partitionBy("dim").orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
