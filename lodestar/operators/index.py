"""A kept index of texts: postings by term, built once, with a manifest that is checked whenever it is opened."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import K1, B, _plain_terms, best, terms

#: Raised when what is written, or how terms are made, changes.
VERSION = 2
#: Folders the postings are spread over by the hash of their term; a search opens only those of its terms.
BUCKETS = 32


class StaleIndex(ValueError):
    """The index is missing, of another version, or of other texts."""


def fingerprint(docs: DataFrame, key: str, text: str) -> str:
    """Of all keys and texts, whatever their order; repeated rows count."""
    n, total = docs.select(F.xxhash64(F.col(key), F.col(text)).cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.sum("h")).first()
    return f"{n}:{total}"


def source_of(docs: DataFrame) -> str:
    """Names, sizes and times of the files behind `docs`: as long as they stay, so do the texts."""
    spark = docs.sparkSession
    rows = []
    for name in sorted(docs.inputFiles()):
        fs, where = _file(spark, name)
        status = fs.getFileStatus(where)
        rows.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(rows).encode()).hexdigest() if rows else ""


def _file(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def build(docs: DataFrame, key: str, text: str, path: str) -> dict:
    """Write the postings and, last of all, the manifest, so that a broken build is never taken for an index.

    Null texts count as empty. Frequencies are counted before the shuffle by term; rows lie by term
    within a bucket, so that a search reads few row groups.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("d"), terms(F.coalesce(F.col(text), F.lit(""))).alias("w")).select("d", "w", F.size("w").alias("len"))
    n, mean = rows.agg(F.count("*"), F.avg("len")).first()  # two numbers
    postings = rows.select("d", "len", F.explode("w").alias("t")).groupBy("d", "len", "t").agg(F.count("*").cast("int").alias("tf"))
    postings = postings.withColumn("bucket", F.pmod(F.xxhash64("t"), F.lit(BUCKETS)).cast("int"))
    # hot terms are long lists: rows of a bucket may lie in several files
    postings.repartition("bucket", F.pmod(F.xxhash64("d"), F.lit(4))).sortWithinPartitions("bucket", "t", "d").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    manifest = {"version": VERSION, "buckets": BUCKETS, "texts": n, "mean_length": mean or 0.0, "key": docs.schema[key].dataType.simpleString(), "fingerprint": fingerprint(docs, key, text), "source": source_of(docs)}
    fs, where = _file(spark, f"{path}/manifest.json")
    out = fs.create(where, True)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    return manifest


def opened(spark: SparkSession, path: str, docs: DataFrame | None = None, key: str = "", text: str = "") -> dict:
    """The manifest of the index at `path`, checked: its version, and against the texts where they are given.

    Files that are as they were when it was built hold the same texts; only otherwise are the texts read.
    """
    fs, where = _file(spark, f"{path}/manifest.json")
    if not fs.exists(where):
        raise StaleIndex(f"no index at {path}")
    stream = fs.open(where)
    try:
        manifest = json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()
    if (manifest.get("version"), manifest.get("buckets")) != (VERSION, BUCKETS):
        raise StaleIndex(f"index at {path} is of version {manifest.get('version')}, wanted is {VERSION}")
    if docs is None or (manifest["source"] and manifest["source"] == source_of(docs)):
        return manifest
    if manifest["fingerprint"] != fingerprint(docs, key, text):
        raise StaleIndex(f"index at {path} is of other texts")
    return manifest


def search(spark: SparkSession, path: str, manifest: dict, key: str, queries: list[tuple[str, str]], k: int = 50) -> DataFrame:
    """What `bm25` gives for the same texts, from the postings of the queries' terms alone."""
    asked = [(name, t) for name, q in queries for t in sorted(set(_plain_terms(q)))]
    wanted = spark.createDataFrame(asked, "query string, t string").withColumn("bucket", F.pmod(F.xxhash64("t"), F.lit(BUCKETS)).cast("int"))
    buckets = sorted({r["bucket"] for r in wanted.select("bucket").distinct().collect()})  # a number a query term
    schema = f"d {manifest['key']}, len int, t string, tf int, bucket int"
    postings = spark.read.schema(schema).parquet(f"{path}/postings")
    hits = postings.where(F.col("bucket").isin(buckets) & F.col("t").isin(sorted({t for _, t in asked}))).select("d", "len", "t", "tf")
    df = hits.groupBy("t").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log((F.lit(manifest["texts"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    norm = K1 * (1 - B + B * F.col("len") / (manifest["mean_length"] or 1.0))
    weighed = hits.join(F.broadcast(df.select("t", idf.alias("idf"))), "t").join(F.broadcast(wanted.select("query", "t")), "t")  # a row a query term
    scored = weighed.select("query", "d", (F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("s"))
    total = scored.groupBy("query", "d").agg(F.round(F.sum("s"), 4).alias("score"))
    return best(total, "d", k).withColumnRenamed("d", key)
