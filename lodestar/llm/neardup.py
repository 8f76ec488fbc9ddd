"""Near-duplicate texts: many universal hash minima, banding, verified signatures, components.

Texts with equal sets of shingles are one class, known by a hash of the set; everything up to the
last step works on classes. Minima of a class go through bands; classes that agree on a whole band
are candidates. A candidate's signatures are compared first, then the exact sets of the survivors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import materialise, release
from ..tables import load

SHINGLE_WORDS = 5
#: Hash minima of a class, in bands of so many rows each: a pair of similarity s is a candidate
#: with probability 1 - (1 - s**ROWS) ** (MINIMA / ROWS), 0.998 at 0.55 and 0.9999 from 0.6.
MINIMA, ROWS = 256, 4
#: How far below the threshold the estimate from the signatures may lie, in standard deviations.
SLACK = 5.0
#: Bytes of text worked on at once.
CHUNK_BYTES, CHUNK_TEXTS = 1 << 20, 4096

_U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240501))
_BYTE = np.zeros(256, _U64)
_BYTE[[*range(48, 58), *range(97, 123)]] = _RNG.integers(1, 2**63, 36, dtype=np.uint64) | _U64(1)
_KEEP = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 0 for b in range(256))
_BASE = int(_RNG.integers(1, 2**62)) * 2 + 1
_WORD_WEIGHTS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | _U64(1)
_A = (_RNG.integers(0, 2**32, MINIMA, dtype=np.uint64) | _U64(1)).astype(np.uint32)
_B = _RNG.integers(0, 2**32, MINIMA, dtype=np.uint64).astype(np.uint32)
_BAND_WEIGHTS = _RNG.integers(1, 2**63, ROWS, dtype=np.uint64) | _U64(1)
_LOW52 = _U64((1 << 52) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U64(33))
    x = x * _U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U64(33))
    x = x * _U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U64(33))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for `n` bytes or more."""
    size = max(CHUNK_BYTES + 1, n)
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE, _U64), np.full(size, pow(_BASE, -1, 2**64), _U64)
        up[0] = down[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(down, out=down)
        _powers[size] = (up, down)
    return _powers[size]


def shingle_sets(texts: list[str], k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (52 bits) of all texts, and the offsets of each text's own, sorted.

    Words are runs of `[a-z0-9]` of the lower-cased text. At most CHUNK_TEXTS texts.
    """
    data = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    starts_of_text = np.cumsum([0, *(len(d) + 1 for d in data)])
    buf = np.frombuffer(b"\n".join([*data, b""]).translate(_KEEP), np.uint8)
    n = len(buf)
    up, down = _power_tables(n + 1)
    inside = buf != 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(first) < k:
        return np.zeros(0, _U64), np.zeros(len(texts) + 1, np.int64)
    total = np.zeros(n + 1, _U64)
    np.cumsum(_BYTE[buf] * up[:n], out=total[1:])
    words = _mix((total[last] - total[first]) * down[first] + (last - first).astype(_U64))
    text = np.searchsorted(starts_of_text, first, "right") - 1
    shingle = np.zeros(len(words) - k + 1, _U64)
    for i in range(k):
        shingle += words[i : len(words) - k + 1 + i] * _WORD_WEIGHTS[i]
    whole = text[: len(words) - k + 1] == text[k - 1 :]
    keyed = (_mix(shingle[whole]) & _LOW52) | (text[: len(words) - k + 1][whole].astype(_U64) << _U64(52))
    keyed = np.sort(keyed)
    if len(keyed):
        keyed = keyed[np.concatenate([[True], keyed[1:] != keyed[:-1]])]
    offsets = np.searchsorted(keyed, np.arange(len(texts) + 1, dtype=np.uint64) << _U64(52)) if len(texts) < 4096 else np.append(
        np.searchsorted(keyed, np.arange(len(texts), dtype=np.uint64) << _U64(52)), len(keyed)
    )
    return keyed & _LOW52, offsets


def minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MINIMA minima of each set: rows are the sets that begin at `starts`."""
    x = (hashes ^ (hashes >> _U64(20))).astype(np.uint32)
    out, h = np.empty((MINIMA, len(starts)), np.uint32), np.empty_like(x)
    for j in range(MINIMA):
        np.multiply(x, _A[j], out=h)
        np.add(h, _B[j], out=h)
        np.minimum.reduceat(h, starts, out=out[j])
    return out.T


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A key of 64 bits for each band of each signature."""
    bands = signatures.reshape(len(signatures), MINIMA // ROWS, ROWS).astype(_U64)
    mixed = _mix(bands) * _BAND_WEIGHTS
    return _mix(mixed.sum(axis=2, dtype=_U64) + np.arange(MINIMA // ROWS, dtype=_U64) * _U64(0x9E3779B97F4A7C15))


def sketches(signatures: np.ndarray) -> np.ndarray:
    """One byte of each minimum, mixed, as minima are small numbers."""
    return ((signatures * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def _chunks(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    where, chunk, size = [], [], 0
    for i, t in enumerate(texts):
        if t is None:
            continue
        if chunk and (size + len(t) > CHUNK_BYTES or len(chunk) == CHUNK_TEXTS - 1):
            yield where, chunk
            where, chunk, size = [], [], 0
        where.append(i)
        chunk.append(t)
        size += len(t)
    if chunk:
        yield where, chunk


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class, size, band keys and sketch of each text; a class's keys and sketch only once a batch."""
    for batch in batches:
        seen: set[tuple[int, int]] = set()
        for where, texts in _chunks(batch.column(1).to_pylist()):
            hashes, offsets = shingle_sets(texts)
            size = np.diff(offsets)
            some = np.flatnonzero(size)
            if not len(some):
                continue
            starts = offsets[:-1][some]
            name = _names(hashes, starts, size[some])
            new = np.zeros(len(some), bool)
            for i, pair in enumerate(zip(name.tolist(), size[some].tolist())):
                if pair not in seen:
                    seen.add(pair)
                    new[i] = True
            ends = offsets[1:][some]
            pick = np.flatnonzero(new)
            if len(pick):
                if len(pick) < len(some):
                    own = np.concatenate([hashes[starts[i] : ends[i]] for i in pick])
                    own_starts = np.cumsum([0, *(ends[pick] - starts[pick])[:-1]])
                else:
                    own, own_starts = hashes, starts
                signatures = minima(own, own_starts)
                keys, sketch = band_keys(signatures).view(np.int64), sketches(signatures)
            bands = MINIMA // ROWS
            key_offsets = np.concatenate([[0], np.cumsum(np.where(new, bands, 0))]).astype(np.int32)
            sketch_offsets = np.concatenate([[0], np.cumsum(np.where(new, MINIMA, 0))]).astype(np.int32)
            flat = pa.array(keys.ravel() if len(pick) else np.zeros(0, np.int64))
            data = sketch.tobytes() if len(pick) else b""
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.array(where)[some])),
                    pa.array(name),
                    pa.array(size[some].astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(key_offsets), flat),
                    pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(sketch_offsets.tobytes()), pa.py_buffer(data)]),
                ],
                ["doc", "class", "size", "keys", "sketch"],
            )


def classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """`doc`, `class`, `size` (distinct shingles), `keys` and `sketch` of each text of enough words.

    `keys` and `sketch` are empty on rows whose class came before in the same Arrow batch: copies
    are folded before anything is shuffled. Written to the shared folder, as every later step reads it.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("doc"), F.col(text).alias("t")).where("t is not null")
    return materialise(rows.mapInArrow(_classes, f"doc {kind}, class bigint, size int, keys array<bigint>, sketch binary"), "classes")


def _agreement(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose sketches agree in `least` places or more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, MINIMA) for i in (2, 3))
        good = pa.array((a == b).sum(axis=1) >= least)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["a", "b"])


def deduplicated(sig: DataFrame) -> DataFrame:
    """Keys and sketch of each class once, as a table."""
    first = sig.where(F.size("keys") > 0).groupBy("class").agg(F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    return materialise(first, "sketches")


def candidate_pairs(once: DataFrame, threshold: float) -> DataFrame:
    """Pairs of classes (`a` < `b`) that share a band and whose signatures pass the estimate.

    `once` holds each class once, in a table (see `deduplicated`): both sides of the join on the band's key
    are then plain shuffles, which AQE splits where a key is hot. Agreeing on a whole
    band of minima, a bucket's pairs are mostly links that the result holds anyway.
    """
    rows = once.select("class", F.explode("keys").alias("k"))
    shared = (
        rows.select("k", F.col("class").alias("a"))
        .join(rows.select("k", F.col("class").alias("b")), "k")
        .where("a < b")
        .select("a", "b")
        .distinct()
    )
    sketches = once.select("class", "sketch")
    with_both = (
        shared.join(sketches.select(F.col("class").alias("a"), F.col("sketch").alias("x")), "a")
        .join(sketches.select(F.col("class").alias("b"), F.col("sketch").alias("y")), "b")
        .select("a", "b", "x", "y")
    )
    expected = threshold + (1 - threshold) / 256
    least = int(MINIMA * expected - SLACK * (MINIMA * expected * (1 - expected)) ** 0.5)
    return with_both.mapInArrow(lambda batches: _agreement(batches, least), "a bigint, b bigint")


def _names(hashes: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The class of each set of shingles."""
    return _mix(np.add.reduceat(_mix(hashes), starts) + size.astype(_U64)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class and members of each text that has any."""
    for batch in batches:
        for _, texts in _chunks(batch.column(0).to_pylist()):
            hashes, offsets = shingle_sets(texts)
            some = np.flatnonzero(np.diff(offsets))
            if len(some):
                bounds = np.append(offsets[:-1][some], len(hashes)).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(bounds), pa.array(hashes.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_names(hashes, offsets[:-1][some], np.diff(offsets)[some])), sets], ["class", "members"])


def _direct(df: DataFrame, key: str) -> DataFrame:
    """`df` with an exchange of its own: what is aggregated by `key` would else be joined where it lies, and AQE
    only splits a hot key of a join whose sides both come straight from a shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(key))


def linked_classes(df: DataFrame, key: str, text: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The table of classes (`doc`, `class`), and the pairs of classes (`a`, `b`, `jaccard`) at `threshold` or above.

    Each table goes after its last use: keys and sketches, once the candidates are written.
    """
    whole = classes(df, key, text)
    once = deduplicated(whole)
    sig = materialise(whole.select("doc", "class"), "members")
    release(whole)
    pairs = materialise(candidate_pairs(once, threshold), "candidates")
    release(once)
    wanted = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    # one text of each wanted class: by its key, but the class is taken from the text itself, as keys may repeat
    speakers = sig.select("class", "doc").join(wanted, "class", "left_semi").groupBy("class").agg(F.min("doc").alias("doc")).select("doc").distinct()
    texts = df.select(F.col(key).alias("doc"), F.col(text).alias("t")).join(speakers.withColumnRenamed("doc", "speaker"), F.col("doc").eqNullSafe(F.col("speaker")), "left_semi")
    sets = texts.select("t").mapInArrow(_sets, "class bigint, members array<bigint>").dropDuplicates(["class"])
    sets = materialise(sets, "sets")
    common = F.size(F.array_intersect("x", "y"))
    links = (
        pairs.join(sets.select(F.col("class").alias("a"), F.col("members").alias("x")), "a")
        .join(sets.select(F.col("class").alias("b"), F.col("members").alias("y")), "b")
        .select("a", "b", common.alias("n"), (F.size("x") + F.size("y")).alias("m"))
        .select("a", "b", (F.col("n") / (F.col("m") - F.col("n"))).alias("jaccard"))
        .where(F.col("jaccard") >= threshold)
    )
    return sig, links


def near_duplicate_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.8) -> DataFrame:
    """All pairs of rows (`key`_a < `key`_b, `jaccard`) whose texts reach `threshold`, copies included.

    Null texts and texts of fewer than SHINGLE_WORDS words have no pairs; rows of a null key have
    none; rows of one key are one row; no rows give no pairs; other columns are not read.
    """
    sig, links = linked_classes(df, key, text, threshold)
    members = sig.select("class", "doc").where("doc is not null").distinct()
    left, right = (members.select(F.col("class").alias(c), F.col("doc").alias(d)) for c, d in (("a", "p"), ("b", "q")))
    between = links.join(left, "a").join(right, "b").select("p", "q", "jaccard")
    within = (
        left.join(right.withColumnRenamed("b", "a"), "a").where("p < q").select("p", "q", F.lit(1.0).alias("jaccard"))
    )
    return (
        between.unionByName(within)
        .where("p <> q")
        .groupBy(F.least("p", "q").alias(f"{key}_a"), F.greatest("p", "q").alias(f"{key}_b"))
        .agg(F.max("jaccard").alias("jaccard"))
    )


def near_duplicate_groups(df: DataFrame, key: str, text: str, threshold: float = 0.8) -> DataFrame:
    """One row per distinct non-null key: `class_id` (the least key of the texts of an equal shingle set),
    `group_id` (the least key of its group) and `n_links`, the number of other classes its text is
    linked with. Texts without shingles are classes and groups of their own. Grows with the rows, not with their pairs.

    A key that comes with different texts takes the least of their groups, and that class.
    """
    sig, links = linked_classes(df, key, text, threshold)
    links = materialise(links, "links")
    component = connected_components(links, "a", "b").select(F.col("node").alias("class"), "component")
    degree = (
        links.select(F.col("a").alias("class")).unionByName(links.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("n_links"))
    )
    members = sig.select("class", "doc").where("doc is not null")
    # from documents to classes before anything else, so a group of copies is one row in all that follows
    least = members.groupBy("class").agg(F.min("doc").alias("least"))
    placed = least.join(component, "class", "left").join(degree, "class", "left").withColumn("component", F.coalesce("component", "class"))
    placed = materialise(placed, "placed")
    group = placed.groupBy("component").agg(F.min("least").alias("group_id"))
    classes_placed = placed.join(_direct(group, "component"), "component").select("class", "group_id", "least", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = members.join(materialise(classes_placed, "groups"), "class").groupBy("doc").agg(F.min(F.struct("group_id", "least", "n_links")).alias("r"))
    everyone = df.select(F.col(key).alias("doc")).where("doc is not null").distinct()
    return everyone.join(rows, "doc", "left").select(
        F.col("doc").alias(key),
        F.coalesce("r.least", "doc").alias("class_id"),
        F.coalesce("r.group_id", "doc").alias("group_id"),
        F.coalesce("r.n_links", F.lit(0)).alias("n_links"),
    )


#: Fixed by the statement of the problem.
FOUND_THRESHOLD = 0.55


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_pairs(load(spark, sf_dir, "documents"), "doc_id", "text", FOUND_THRESHOLD).select("doc_id_a", "doc_id_b")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups at the similarity of the statement."""
    return near_duplicate_groups(load(spark, sf_dir, "documents"), "doc_id", "text", FOUND_THRESHOLD)
