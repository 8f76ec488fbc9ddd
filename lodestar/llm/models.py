"""Trained networks kept by what decides them, so that equal samples train once.

Where the setting `spark.lodestar.models.dir` names a folder, they are written there and read by later
queries and applications; without it every query trains anew.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterable
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

Arrays = dict[str, np.ndarray]


def digest(sample: Iterable, modules: Iterable[str], *parameters) -> str:
    """Of the sample, the parameters and the source of the modules that train: what decides a network."""
    h = hashlib.blake2b(digest_size=16)
    for name in sorted(modules):
        h.update(Path(__file__).with_name(f"{name}.py").read_bytes())
    h.update(repr(parameters).encode())
    for row in sample:
        h.update(repr(row).encode("utf-8", "surrogatepass") + b"\0")
    return h.hexdigest()


def save(spark: SparkSession, path: str, arrays: Arrays) -> None:
    """Write under another name first, so that a reader never sees a part."""
    data = io.BytesIO()
    np.savez(data, **arrays)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    final = jvm.org.apache.hadoop.fs.Path(path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{spark.sparkContext.applicationId}")
    fs = final.getFileSystem(conf)
    out = fs.create(part, True)
    try:
        out.write(bytearray(data.getvalue()))
    finally:
        out.close()
    if not fs.rename(part, final):  # another application was faster
        fs.delete(part, False)


def read(spark: SparkSession, path: str) -> Arrays | None:
    """The arrays written by `save`, or None where there are none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        data = bytes(stream.readAllBytes())
    finally:
        stream.close()
    with np.load(io.BytesIO(data), allow_pickle=False) as found:
        return {k: found[k] for k in found.files}


def trained(spark: SparkSession, name: str, key: str, train: Callable[[], Arrays]) -> Arrays:
    """The arrays of this name and digest from the folder of models, or trained now and kept there."""
    folder = spark.conf.get("spark.lodestar.models.dir", "") or ""
    path = f"{folder.rstrip('/')}/{name}-{key}.npz"
    arrays = read(spark, path) if folder else None
    if arrays is None:
        arrays = train()
        if folder:
            save(spark, path, arrays)
    return arrays
