import duckdb
import pytest

import __spark_entry__ as entry
from lodestar.plans.core import registry

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p4_found", "p6_found"} <= set(registry.queries)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.sql))
def test_same_as_sql(spark, name):
    from compare import rows

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in "candidates chunks documents embeddings employers employment eval_items events run_states titles".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries[name](spark, SF)
    rel = con.sql(registry.sql[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())


def test_a_session_built_elsewhere():
    """Queries run in a session that knows none of this package's settings."""
    import subprocess
    import sys

    code = f"""from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from lodestar.plans.core import registry
print("rows", registry.queries["p4_found"](spark, "{SF}").count())"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and int(done.stdout.split("rows")[1]) > 0, done.stderr[-2000:]
