"""Sources and sinks of records: profile artefacts, flat imports, exports, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: The names under which a flat import may carry each field, the first present counts.
ALIASES = {
    "name": ["name", "full_name", "candidate_name"],
    "headline": ["headline", "title"],
    "summary": ["summary", "notes"],
    "region": ["region", "location", "geography"],
    "years": ["years_experience", "years"],
    "skills": ["skills"],
    "strategy": ["strategy", "strategies"],
    "sector": ["sector", "sectors"],
    "seniority": ["seniority", "seniority_level"],
}


def profile_artefact(spark: SparkSession, path: str) -> DataFrame:
    """(`candidate_id`, `payload`) of JSON files of the form {"candidates": [...]}; whole files, in parallel by file."""
    raw = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.candidates").alias("c"))
    items = raw.select(F.explode(F.from_json("c", "array<string>")).alias("payload"))
    return items.select(F.get_json_object("payload", "$.candidate_id").alias("candidate_id"), "payload")


def flat_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV of text columns with its bad lines kept in `_corrupt_record`."""
    schema = StructType([StructField(c, StringType()) for c in [*columns, "_corrupt_record"]])
    return spark.read.schema(schema).option("header", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("enforceSchema", "false").csv(path)


def import_flat(df: DataFrame) -> DataFrame:
    """Flat rows under any of the alias names as typed rows with a `problem`; a bad row is kept, never the batch dropped.

    Header names count without case and with blanks and hyphens as underscores; skills are cut at
    commas and semicolons; years that are no number are NULL and a problem, as is a missing name.
    """
    named = df.toDF(*[c.strip().lower().replace(" ", "_").replace("-", "_") for c in df.columns])
    out = {}
    for field, names in ALIASES.items():
        have = [F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in named.columns]
        out[field] = F.coalesce(*have) if have else F.lit(None).cast("string")
    rows = named.select(*[c.alias(k) for k, c in out.items()])
    years = F.col("years").try_cast("double")
    listed = F.filter(F.transform(F.split(F.coalesce("skills", F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    problem = F.when(F.col("name").isNull(), "no name").when(F.col("years").isNotNull() & years.isNull(), "years is no number")
    return rows.withColumns({"problem": problem, "skills": listed, "years": years})


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Long form with a header; arrays are joined by `; `."""
    flat = [F.array_join(c, "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", "true").csv(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def synthetic_pool(spark: SparkSession, n: int, seed: int, grid: dict[str, list[str]]) -> DataFrame:
    """`n` candidates whose fields are drawn by hashes of seed and id: the same for every partitioning."""
    draw = lambda name: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}|{name}"), F.col("id"))), 1, 8), 16, 10).cast("bigint"), F.lit(len(grid[name])))
    fields = [F.get(F.array(*map(F.lit, values)), draw(name).cast("int")).alias(name) for name, values in grid.items()]
    return spark.range(n).select(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col("id")), 256), 1, 16).alias("candidate_id"), *fields)
