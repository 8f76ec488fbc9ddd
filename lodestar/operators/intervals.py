"""Interval algebra per entity: continuous periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import month_label, read_month
from ..tables import load

#: What `present` means in the tables of employment.
AS_OF = "2025-12"


def merge_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Continuous periods (`key`, `start`, `end`) of half-open integer intervals.

    Overlapping, nested and touching intervals merge. Rows with a null side, or an end that is
    not after the start, take no part; a null key is a key of its own. No rows give no periods.
    Other columns of `df` are dropped before anything else, so their names cannot clash.

    The longest interval of each start covers the others of that start, so they are folded
    before the shuffle: a hot key sends one row a start, however many rows it has. Then
    `session_window`, with each row's own length as gap, merges what overlaps.
    """
    rows = df.select(F.col(key).alias("k"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    # tested inside the aggregate: a filter before it would repeat the caller's expressions in the plan
    longest = rows.groupBy("k", "s").agg(F.max(F.when(F.col("e") > F.col("s"), F.col("e"))).alias("e")).where("e is not null")
    session = F.session_window(F.timestamp_seconds("s"), F.concat((F.col("e") - F.col("s")).cast("string"), F.lit(" seconds")))
    merged = (
        longest.groupBy("k", session.alias("w"))
        .agg(F.max("e").alias("e"))
        .select("k", F.unix_seconds("w.start").alias("s"), "e")
    )
    # session_window's treatment of windows that only touch is not part of its contract
    by_key = Window.partitionBy("k").orderBy("s")
    return (
        merged.withColumn("first", (F.coalesce(F.lag("e").over(by_key), F.col("s") - 1) < F.col("s")).cast("int"))
        .withColumn("island", F.sum("first").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("k", "island")
        .agg(F.min("s").alias(start), F.max("e").alias(end))
        .select(F.col("k").alias(key), start, end)
    )


def periods_and_gaps(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """`merge_intervals` as rows of kind `period`, with a row of kind `gap` between neighbours.

    A gap runs from the end of a period to the start of the next of the same key.
    """
    by_key = Window.partitionBy(key).orderBy(start)
    periods = merge_intervals(df, key, start, end).withColumn("next_start", F.lead(start).over(by_key))
    kinds = F.array(
        F.struct(F.lit("period").alias("kind"), F.col(start).alias("a"), F.col(end).alias("b")),
        F.when(
            F.col("next_start").isNotNull(),
            F.struct(F.lit("gap").alias("kind"), F.col(end).alias("a"), F.col("next_start").alias("b")),
        ),
    )
    return (
        periods.select(key, F.explode(F.array_compact(kinds)).alias("x"))
        .select(key, "x.kind", F.col("x.a").alias(start), F.col("x.b").alias(end))
    )


def employment_months(employment: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """(`candidate_id`, `from_index`, `to_index`) of each role, null where a side is unreadable.

    Sides are read by `read_month`. A null or empty end of a current role is `as_of`.
    """
    empty = F.coalesce(F.trim("end"), F.lit("")) == ""
    ended = F.when(empty & F.col("is_current"), F.lit("present")).otherwise(F.col("end"))
    return employment.select("candidate_id", read_month(F.col("start"), as_of).alias("from_index"), read_month(ended, as_of).alias("to_index"))


def employment_periods(employment: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Continuous periods of each candidate's roles and the gaps between them, as month labels."""
    months = employment_months(employment, as_of)
    return periods_and_gaps(months, "candidate_id", "from_index", "to_index").select(
        "candidate_id",
        "kind",
        month_label(F.col("from_index")).alias("from_month"),
        month_label(F.col("to_index")).alias("to_month"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return employment_periods(load(spark, sf_dir, "employment"))
