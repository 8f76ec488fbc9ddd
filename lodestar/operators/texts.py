"""Whole-text operators over a table with a key and a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import redact_injections, stop_word_counts
from ..session import materialise, release


def language_guess(df: DataFrame, key: str, text: str) -> DataFrame:
    """(`key`, `guess`, `share`): the language with most stop words, ties in the order en, fr, es, pt.

    NULL texts give NULLs; texts without stop words are en with share 0.
    """
    s = df.select(key, stop_word_counts(F.col(text)).alias("n")).select(key, "n.*")
    codes = ["en", "fr", "es", "pt"]
    best = F.greatest(*codes)
    guess = F.coalesce(*[F.when(F.col(c) == best, F.lit(c)) for c in codes])
    total = sum((F.col(c) for c in codes[1:]), F.col(codes[0]))
    return s.select(key, guess.alias("guess"), F.round(best / F.greatest(F.lit(1), total), 3).alias("share"))


def lines_with_offsets(df: DataFrame, key: str, text: str) -> DataFrame:
    """(`key`, `line_no`, `char_start`, `char_end`, `line`) of every line, offsets in code points of the text."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null")
    return rows.mapInArrow(_lines, f"k {kind}, line_no int, char_start int, char_end int, line string").withColumnRenamed("k", key)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of each text. A running sum of lengths over an array is quadratic by lambdas, and a window would shuffle."""
    for batch in batches:
        for i, t in enumerate(batch.column(1).to_pylist()):
            lines = t.split("\n")
            size = np.fromiter(map(len, lines), np.int32, len(lines))
            start = np.cumsum(size + 1, dtype=np.int32) - size - 1
            columns = [batch.column(0).take(pa.array(np.full(len(lines), i))), *(pa.array(x, pa.int32()) for x in (np.arange(len(lines)), start, start + size)), pa.array(lines, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["k", "line_no", "char_start", "char_end", "line"])


#: Headings of the sections of a résumé, in lower case without marks.
SECTIONS = {
    "summary": r"(professional |executive )?(summary|profile|objective)|profil(o)?|perfil|kurzprofil|resume du profil",
    "experience": r"(work |professional |employment )?(experience|history)|employment|esperienza|experiencia|berufserfahrung",
    "education": r"education|academic (background|qualifications)|etudes|formacion|formacao|istruzione|ausbildung",
    "skills": r"(technical |core )?skills( (&|and) tools)?|competences|competencias|competenze|habilidades|fahigkeiten",
    "certifications": r"certifications?|licen[cs]es( and certifications)?",
    "publications": r"publications?|research papers",
    "languages": r"languages|langues|idiomas|lingue|sprachen",
    "references": r"references|referencias|referenze|referenzen",
}


def section_segments(df: DataFrame, key: str, text: str) -> DataFrame:
    """(`key`, `section`, `char_start`, `char_end`): from a heading to the next; repeats extend the section.

    A heading is a line of at most 60 characters that begins with a capital (title case and capitals throughout do,
    too) and whose words are one of SECTIONS, with or without a colon.
    """
    from ..functions.text import normalise

    lines = lines_with_offsets(df, key, text).withColumn("n", F.regexp_replace(normalise(F.col("line")), " ?:$", ""))
    section = F.coalesce(*[F.when(F.regexp_like("n", F.lit(f"^({p})$")), F.lit(k)) for k, p in SECTIONS.items()])
    heads = lines.where((F.length("line") <= 60) & F.regexp_like("line", F.lit(r"^[^\p{L}]*\p{Lu}"))).withColumn("section", section).where("section is not null")
    ends = df.select(key, F.length(text).alias("text_end"))
    by_key = Window.partitionBy(key).orderBy("char_start")
    spans = heads.withColumn("next_start", F.lead("char_start").over(by_key)).join(ends, key)
    return spans.groupBy(key, "section").agg(
        F.min("char_start").alias("char_start"), F.max(F.coalesce("next_start", "text_end")).alias("char_end")
    )


def injection_findings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(`key`, `family`, `severity`, `hits`) of the families that occur, scanned one on the other's result."""
    _, counts = redact_injections(F.col(text))
    rows = F.array(*[F.struct(F.lit(n).alias("family"), F.lit(s).alias("severity"), c.alias("hits")) for n, s, c in counts])
    return df.select(key, F.explode(rows).alias("x")).select(key, "x.*").where("hits > 0")


def exact_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(`key`, `first_key`, `copies`) of every row whose text occurs more than once. NULL texts are no copies."""
    groups = df.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("h")).agg(F.min(key).alias("first_key"), F.count("*").alias("copies")).where("copies > 1")
    return df.select(key, F.sha2(text, 256).alias("h")).join(groups, "h").select(key, "first_key", "copies")


def shingle_sets(df: DataFrame, key: str, text: str, k: int = 5) -> DataFrame:
    """(`id`, `s`): the sorted set of hashes of `k` consecutive `[a-z0-9]` words of each text that has as many."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    listed = df.select(F.col(key).alias("id"), words.alias("w")).where(F.size("w") >= k)
    tokens = listed.select("id", F.posexplode("w").alias("pos", "w"))
    by_text = Window.partitionBy("id").orderBy("pos")
    gram = F.xxhash64(*[F.lead("w", i).over(by_text) if i else F.col("w") for i in range(k)])
    grams = tokens.select("id", gram.alias("g"), F.lead("w", k - 1).over(by_text).isNotNull().alias("whole")).where("whole").select("id", "g").distinct()
    return grams.groupBy("id").agg(F.sort_array(F.collect_set("g")).alias("s"))  # one text's own words


def shingle_classes(df: DataFrame, key: str, text: str, k: int = 5) -> DataFrame:
    """(`key`, `class_id`, `copies`) of every text with shingles: texts of equal sets are one class, known by its least key.

    With `shingle_pairs`, whose pairs are those of classes, every link between two documents is there,
    without expanding copies into pairs. Sets are compared by a hash and their size; a class is one row
    before it is joined, and that side has an exchange of its own, so a hot class can be split.
    """
    named = shingle_sets(df, key, text, k).select("id", F.xxhash64("s").alias("h"), F.size("s").alias("n"))
    least = named.groupBy("h", "n").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    least = least.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("h"))
    return named.join(least, ["h", "n"]).select(F.col("id").alias(key), "class_id", "copies")


#: Counters of the sketch of how often shingles occur; it only orders them. Words worked on at once, and texts.
COUNTERS, CHUNK_WORDS, CHUNK_TEXTS = 1 << 22, 1 << 20, 4095
#: Share of the mean size of two sets that their beginnings must have in common, where those are long enough.
SHARED = 0.03

_U64 = np.uint64
_LOW52 = _U64((1 << 52) - 1)
_WEIGHTS = np.random.Generator(np.random.PCG64(20240501)).integers(1, 2**63, 64, dtype=np.uint64) * _U64(2) + _U64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> _U64(33))) * _U64(factor)
    return x ^ (x >> _U64(33))


def _hashed_sets(words: pa.ListArray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sets of the lists of hashed words, some at a time: rows that have any, where their shingles (52 bits) begin, and these, each set sorted."""
    ends, at = words.offsets.to_numpy().astype(np.int64), 0
    flat = words.values.to_numpy().view(_U64)
    while at < len(words):
        to = max(at + 1, min(at + CHUNK_TEXTS, int(np.searchsorted(ends, ends[at] + CHUNK_WORDS, "right")) - 1))
        w = flat[ends[at] : ends[to]]
        own = np.repeat(np.arange(to - at, dtype=_U64), np.diff(ends[at : to + 1]))
        n = max(0, len(w) - k + 1)
        gram = np.zeros(n, _U64)
        for i in range(k):
            gram += w[i : n + i] * _WEIGHTS[i]
        whole = own[:n] == own[len(own) - n :]
        keyed = (_mix(gram[whole]) & _LOW52) | (own[:n][whole] << _U64(52))
        keyed.sort()
        if len(keyed):
            keyed = keyed[np.diff(keyed, prepend=~keyed[:1]) != 0]
            row = (keyed >> _U64(52)).astype(np.int64)
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            yield row[starts] + at, starts, keyed & _LOW52
        at = to


def _slots(grams: np.ndarray) -> np.ndarray:
    return (_mix(grams) % _U64(COUNTERS)).astype(np.int64)


def _surveyed(batches: Iterator[pa.RecordBatch], k: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Hash and size of each set; in the end, one sketch a task, in 64 parts."""
    count, names = np.zeros(COUNTERS, np.int32), ["id", "h", "n", "part", "c"]
    for batch in batches:
        for rows, starts, grams in _hashed_sets(batch.column(1), k):
            sizes, h = np.diff(np.append(starts, len(grams))), np.add.reduceat(_mix(grams), starts)
            first = np.zeros(len(h), bool)
            first[np.unique(h, return_index=True)[1]] = True  # most copies count once
            count += np.bincount(_slots(grams[np.repeat(first, sizes)]), minlength=COUNTERS).astype(np.int32)
            own = batch.column(0).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([own, pa.array(h.view(np.int64)), pa.array(sizes.astype(np.int32)), pa.nulls(len(h), pa.int32()), pa.nulls(len(h), pa.binary())], names)
    if count.any():
        parts = pa.array([x.tobytes() for x in np.split(count, 64)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.nulls(64, kind), pa.nulls(64, pa.int64()), pa.nulls(64, pa.int32()), pa.array(range(64), pa.int32()), parts], names)


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in table.column(1).to_pylist())
    total = np.minimum(total, 2**31 - 1).astype(np.int32)
    return pa.table({"part": table.column(0)[:1].cast(pa.int32()), "c": pa.array([total.tobytes()], pa.binary())})


def _beginnings(batches: Iterator[pa.RecordBatch], k: int, threshold: float, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rarest shingles of each set with their places in it; those counted once have no partner."""
    for batch in batches:
        for rows, starts, grams in _hashed_sets(batch.column(1), k):
            sizes = np.diff(np.append(starts, len(grams)))
            own, often = np.repeat(np.arange(len(starts)), sizes), count[_slots(grams)]
            # sets come sorted by shingle, so a stable sort by count leaves ties in that order
            order = np.argsort((own.astype(np.int64) << 32) | often, kind="stable")
            n, place = np.repeat(sizes, sizes), np.arange(len(grams)) - np.repeat(starts, sizes)
            keep = (place <= n - np.ceil(n * threshold - 1e-9)) & (often[order] > 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows[own[keep]])), *(pa.array(x[keep].astype(np.int32)) for x in (n, place)), pa.array(grams[order][keep].view(np.int64))], ["id", "n", "i", "g"]
            )


def _listed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, starts, grams in _hashed_sets(batch.column(1), k):
            sets = pa.ListArray.from_arrays(pa.array(np.append(starts, len(grams)).astype(np.int32)), pa.array(grams.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), sets], ["id", "s"])


def shingle_pairs(df: DataFrame, key: str, text: str, threshold: float, k: int = 5) -> DataFrame:
    """All pairs (`key`_a < `key`_b, `jaccard`) of classes at `threshold` or above, exactly; `shingle_classes` tells
    which documents each class holds.

    Texts are reduced to their sets of `k` consecutive `[a-z0-9]` words; equal sets count once, by
    their least key. Two sets of n and m shingles that reach the threshold share a = ceil(t / (1 + t) * (n + m)) of them,
    so the first n - a + l of one and m - a + l of the other have l in common, in whatever order all sets are sorted. They
    are sorted by a sketch of fixed size that counts the shingles of all texts: hot ones come last and drop out without a
    cap. Only these beginnings are joined; sets are made again for the few pairs that have l in common, and decide.
    """
    spark = df.sparkSession
    kind, arrow = df.schema[key].dataType.simpleString(), to_arrow_type(df.schema[key].dataType)
    texts = df.select(F.col(key).alias("id"), F.col(text).alias("t")).where("id is not null and t is not null")

    def over(texts: DataFrame, run, schema: str) -> DataFrame:
        words = F.transform(F.regexp_extract_all(F.lower("t"), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.xxhash64(w))
        return texts.select("id", words.alias("w")).mapInArrow(run, schema)

    whole = materialise(over(texts, lambda b: _surveyed(b, k, arrow), f"id {kind}, h bigint, n int, part int, c binary"), "sets")
    # all but the least key of each class, as a table: its size then decides how it is joined
    named = whole.where("h is not null").select("id", "h", "n")
    several = named.groupBy("h", "n").agg(F.min("id").alias("least"), F.count("*").alias("c")).where("c > 1").select("h", "n", "least")
    copies = materialise(named.join(several, ["h", "n"]).where("id <> least").select("id"), "copies")
    once = texts.join(copies, "id", "left_anti")
    parts = whole.where("part is not null").select("part", "c").groupBy("part").applyInArrow(_added, "part int, c binary").collect()  # 64 at most
    release(whole)
    count = np.concatenate([np.frombuffer(r.c, np.int32) for r in sorted(parts, key=lambda r: r.part)] or [np.zeros(COUNTERS, np.int32)])
    sent = spark.sparkContext.broadcast(count)
    begun = over(once, lambda b: _beginnings(b, k, threshold, sent.value), f"id {kind}, n int, i int, g bigint")
    a, b = (begun.select(F.col("g"), *(F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "i"))) for x in "ab")
    n, m = F.col("n_a"), F.col("n_b")
    least = F.ceil((n + m) * F.lit(threshold / (1 + threshold)) - 1e-9)
    room = lambda c: least + 1 - F.ceil(c * F.lit(threshold) - 1e-9)
    shared = F.greatest(F.lit(1), F.least(F.ceil((n + m) * F.lit(SHARED / 2)), room(n), room(m)))
    met = a.join(b, "g").where("id_a < id_b").where(F.least(n, m) + 1e-9 >= F.greatest(n, m) * F.lit(threshold))
    met = met.where((F.col("i_a") < n - least + shared) & (F.col("i_b") < m - least + shared))
    counted = met.groupBy("id_a", "id_b", shared.alias("l")).agg(F.count("*").alias("c")).where("c >= l")
    pairs = materialise(counted.select("id_a", "id_b"), "pairs")
    wanted = pairs.select(F.col("id_a").alias("id")).unionByName(pairs.select(F.col("id_b").alias("id"))).distinct()
    sets = over(once.join(wanted, "id", "left_semi"), lambda b: _listed(b, k), f"id {kind}, s array<bigint>")
    left, right = (sets.select(F.col("id").alias(f"id_{x}"), F.col("s").alias(f"s_{x}")) for x in "ab")
    both = pairs.join(left, "id_a").join(right, "id_b").select("id_a", "id_b", F.size(F.array_intersect("s_a", "s_b")).alias("i"), (F.size("s_a") + F.size("s_b")).alias("n"))
    score = F.col("i") / (F.col("n") - F.col("i"))
    return both.where(score >= threshold).select(F.col("id_a").alias(f"{key}_a"), F.col("id_b").alias(f"{key}_b"), F.round(score, 4).alias("jaccard"))
