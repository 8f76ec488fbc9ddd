"""Session factory and the settings every operator relies on."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Needed for right results, whatever cluster the session runs on. Where the sides of a union are partitioned alike,
#: 4.1.2 may take the union for so partitioned, and an aggregate above it then finds a key's rows in two places.
SEMANTIC_CONF = {"spark.sql.session.timeZone": "UTC", "spark.sql.unionOutputPartitioning": "false"}

#: Runtime re-planning. Sizes of partitions stay the cluster's business.
ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "lodestar", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session; `master` and `conf` only matter where none runs yet."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SEMANTIC_CONF | ADAPTIVE_CONF | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def settled(spark: SparkSession) -> SparkSession:
    """The session with what right results need, for one that was built elsewhere; its time zone is left alone."""
    key = "spark.sql.unionOutputPartitioning"
    spark.conf.set(key, SEMANTIC_CONF[key])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where that is unset and the master is local (tests), a temporary folder is used.
    """
    path = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not path:
        known = spark.sparkContext.getCheckpointDir()
        if known:
            return known.rsplit("/", 1)[0]
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), f"lodestar-{os.getuid()}")
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Write `df` reliably to the shared folder and cut its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    Columnar and compressed, so it is the smaller cut of lineage for wide rows; the folder
    belongs to the application and is removed with it (see `cleanup`).
    """
    spark = df.sparkSession
    if not _written:
        atexit.register(_leave)
    path = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}-tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _written.append((spark.sparkContext.applicationId, path))
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def release(table: DataFrame) -> None:
    """Delete what `materialise` wrote for `table`, before the session ends; nothing may read it afterwards."""
    spark, path = table.sparkSession, table._written_to
    _delete(spark, path)
    _written.remove((spark.sparkContext.applicationId, path))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_written: list[tuple[str, str]] = []


def _leave() -> None:
    """At the end of the driver's process: remove what is left, where the session still runs."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            cleanup(spark)
        except Exception:  # the JVM may be gone already
            pass


def cleanup(spark: SparkSession, keep_last: int = 0) -> None:
    """Delete what `materialise` wrote for this application, but for the newest `keep_last`."""
    app = spark.sparkContext.applicationId
    own = [p for a, p in _written if a == app]
    for path in own[: len(own) - keep_last]:
        _delete(spark, path)
        _written.remove((app, path))
