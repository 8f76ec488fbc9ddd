"""Candidate-shaped views of the tables: latest profiles, roles, skills and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import let, month_index, parse_date
from ..tables import load
from .intervals import AS_OF

#: What a scorer may see. No name, contact or other protected attribute is among them.
SCORABLE = ["candidate_id", "region", "country", "seniority_level", "years_experience", "approach", "feeder_path", "completeness"]
PROTECTED = ["full_name", "email", "phone", "photo_present", "marital_status", "nationality", "date_of_birth"]


def profiles(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The latest row of each candidate: last writer wins, ties by the greater values of the other
    columns in the order of their names, the payload last.

    With `columns`, only these come out, of the same row whatever they are: rows that tie in all but
    the payload are equal in all else, so the payload is read only where it is asked for. The latest
    time is found first by itself; what is compared as a whole is then little more than a row a candidate.
    """
    df = load(spark, sf, "candidates")
    wanted = [c for c in columns or df.columns if c != "candidate_id"]
    order = sorted(c for c in df.columns if c not in ("candidate_id", "updated_at", "payload")) + ["payload"] * ("payload" in wanted)
    newest = df.groupBy(F.col("candidate_id").alias("__id")).agg(F.max("updated_at").alias("__at"))
    same = F.col("candidate_id").eqNullSafe(F.col("__id")) & F.col("updated_at").eqNullSafe(F.col("__at"))
    rows = df.join(newest, same, "left_semi")
    return rows.groupBy("candidate_id").agg(F.max_by(F.struct(*wanted), F.struct(*order)).alias("r")).select("candidate_id", "r.*")


def profile_json(payload: Column) -> Column:
    """The profile object of a payload as JSON text: a JSON string is read through, `data` counts where present."""
    inner = F.when(F.startswith(F.ltrim(payload), F.lit('"')), F.get(F.from_json(F.concat(F.lit("["), payload, F.lit("]")), "array<string>"), F.lit(0))).otherwise(payload)
    return let(inner, lambda p: F.coalesce(F.get_json_object(p, "$.data"), p))


def skills(spark: SparkSession, sf: str) -> DataFrame:
    """(`candidate_id`, `skill`, `depth`) of the latest profiles, each once."""
    text = F.get_json_object(profile_json(F.col("payload")), "$.skills")
    items = F.from_json(text, "array<struct<canonical:string,depth:string>>")
    rows = profiles(spark, sf, "payload").select("candidate_id", F.explode(items).alias("x"))
    return rows.select("candidate_id", F.col("x.canonical").alias("skill"), F.col("x.depth").alias("depth")).where("skill is not null").distinct()


def strategies(spark: SparkSession, sf: str) -> DataFrame:
    """(`candidate_id`, `strategy`) of the latest profiles: labels and bare strings, each once."""
    text = F.get_json_object(profile_json(F.col("payload")), "$.strategies")
    listed = F.when(F.startswith(text, F.lit("[")), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    # a lone string comes out of get_json_object without its quotes
    lone = F.when(~F.regexp_like(text, F.lit(r"^[\[{]")), F.array(text))
    parts = F.coalesce(lone, F.from_json(listed, "array<string>"))
    rows = profiles(spark, sf, "payload").select("candidate_id", F.explode(parts).alias("x"))
    label = F.when(F.startswith("x", F.lit("{")), F.get_json_object("x", "$.label")).otherwise(F.col("x"))
    return rows.select("candidate_id", label.alias("strategy")).where("strategy is not null and strategy <> ''").distinct()


def roles(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (`candidate_id`, `seq`) of the latest delivery, with `s` and `e` as month indexes."""
    df = load(spark, sf, "employment")
    columns = [c for c in df.columns if c not in ("candidate_id", "seq")]
    newest = df.groupBy("candidate_id", "seq").agg(F.max_by(F.struct(*columns), F.struct("ingested_at", "recorded_at", "start", "end", "title")).alias("r"))
    rows = newest.select("candidate_id", "seq", "r.*")
    ended = F.when((F.coalesce(F.trim("end"), F.lit("")) == "") & F.col("is_current"), F.lit("present")).otherwise(F.col("end"))
    index = lambda text: let(parse_date(text, 100, 2099), lambda x: month_index(x, AS_OF))
    return rows.withColumns({"s": index(F.col("start")), "e": index(ended)})


def current_role(rows: DataFrame) -> DataFrame:
    """The role each candidate is in: current and paid, else current, else the latest known start, then the least seq."""
    paid = F.col("is_current") & ~F.coalesce("is_internship", F.lit(False))
    order = [F.coalesce(paid, F.lit(False)).desc(), F.coalesce("is_current", F.lit(False)).desc(), F.col("s").desc_nulls_last(), F.col("seq")]
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("candidate_id").orderBy(*order))).where("r = 1").drop("r")
