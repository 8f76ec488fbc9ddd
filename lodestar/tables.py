"""Loaders of the Parquet tables of a directory, with their columns checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The columns each operator may rely on.
COLUMNS = {
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "candidates": ["candidate_id", "payload", "updated_at"],
    "employment": ["candidate_id", "seq", "employer_raw", "title", "start", "end", "is_current"],
    "chunks": ["chunk_id", "candidate_id", "text"],
    "run_states": ["state_id", "raw_text"],
    "employers": ["employer_id", "employer_canonical", "aliases"],
    "titles": ["title_id", "title_canonical", "aliases"],
    "eval_items": ["item_id", "text"],
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read `name` of `sf_dir`; a missing column is reported at once, not inside a later plan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    missing = [c for c in COLUMNS.get(name, []) if c not in df.columns]
    if missing:
        raise ValueError(f"table {name} lacks {', '.join(missing)}")
    return df
