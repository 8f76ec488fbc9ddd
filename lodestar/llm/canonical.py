"""Freely typed values mapped to a reference list.

Distinct values are normalised (accents, look-alike letters, separators); candidates come from an
inverted index of the character n-grams of the typed words as they stand. Each candidate is then read
word by word: a misspelt, abbreviated or joined word counts as the word of the candidate it stands for,
unless it is, or is closer to, another word of the list. The reading is scored by cosine weighted with
inverse document frequency; the best is accepted above a threshold and a margin over the best entry of
another id, if all the words that tell entries apart are there.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from ..tables import load

GRAM = 3
THRESHOLD = 0.6
MARGIN = 0.04
#: Least cosine of the typed n-grams with a form's for it to be a candidate, as such and beside the best.
RETRIEVE, RETRIEVE_SHARE = 0.1, 0.4

#: Entries of the reference list in one index; a longer list is searched block by block.
BLOCK_ENTRIES = 50_000

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("асеорхуіјѕАВСЕНКМОРТХУІЈЅαοεικνρτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aceopxyijsABCEHKMOPTXYIJSaoeiknptuABEZHIKMNOPTYX")

#: Words that join others and name nothing.
STOP_WORDS = {"the", "of", "and", "for", "de", "der", "la"}

#: Legal forms, which name nothing.
LEGAL_FORMS = {
    "ag", "bv", "co", "company", "corp", "corporation", "gmbh", "group", "holding", "holdings", "inc", "limited",
    "llc", "llp", "lp", "ltd", "nv", "plc", "pte", "sa", "sarl", "se", "spa", "srl",
}


def fold(text: str) -> str:
    """Lower case without accents, look-alike letters and what stands in brackets; words and single blanks only."""
    text = re.sub(r"[(\[{][^)\]}]*[)\]}]?", " ", text.translate(LOOKALIKES).replace("ß", "ss").replace("&", " and "))
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").lower()
    return " ".join(re.findall(r"[a-z0-9]+", text))


def tokens_of(text: str) -> list[str]:
    """Words of the folded text without joining words; letters that stand alone in a row are one word (`v p`)."""
    out: list[str] = []
    lone = False
    for w in fold(text).split():
        if len(w) == 1 and lone:
            out[-1] += w
        else:
            out.append(w)
        lone = len(w) == 1
    return [w for w in out if w not in STOP_WORDS]


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours from `a` to `b`, or `most` + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            n = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                n = min(n, before[j - 2] + 1)
            row.append(n)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def allowed(word: str) -> int:
    return 0 if len(word) < 4 else 1 if len(word) < 6 else 2


def abbreviates(short: str, word: str) -> bool:
    """Whether `short` begins as `word` does and has its letters in their order."""
    if not 2 <= len(short) < len(word) or short[0] != word[0]:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


def grams(words: list[str], n: int = GRAM) -> dict[str, int]:
    """Character n-grams within words, whose order doesn't count."""
    out: dict[str, int] = defaultdict(int)
    for w in words:
        padded = f" {w} "
        for i in range(len(padded) - n + 1):
            out[padded[i : i + n]] += 1
    return out


def sought(words: list[str]) -> dict[str, int]:
    """What forms are retrieved by: the n-grams within words, and those of the words' initials, which abbreviations keep."""
    return grams(words) | grams(["\x01".join(["", "".join(w[0] for w in words), ""])])


Entry = tuple[int, str, list[str]]


def forms_of(entries: Iterable[Entry]) -> Iterator[tuple[int, list[str]]]:
    """(id, words) of each name and alias that has any."""
    for ref, name, aliases in entries:
        for form in (name, *aliases):
            words = tokens_of(form or "")
            if words:
                yield ref, words


class ListStatistics:
    """What the whole list knows of its words and n-grams, however it is cut into blocks afterwards."""

    def __init__(self, entries: Iterable[Entry]) -> None:
        front, later, df, n = set(), set(), Counter(), 0
        for _, words in forms_of(entries):
            n += 1
            front.update(words[:2])
            later.update(words[2:])
            df.update(sought(words).keys())
        # words that never stand at the front of a form of more than two words tell no entries apart
        self.generic = later - front
        self.idf = {g: math.log(1 + n / d) for g, d in df.items()}
        self.vocabulary = sorted(front | later)
        self.known = set(self.vocabulary)
        postings: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(self.vocabulary):
            for g in grams([w], 2):
                postings[g].append(i)
        self.postings = {g: np.array(x, np.int32) for g, x in postings.items()}
        self.length = np.array([len(w) for w in self.vocabulary], np.int32)
        self._spelt: dict[str, tuple[int, frozenset[str]]] = {}

    def spelt(self, token: str) -> tuple[int, frozenset[str]]:
        """The distance of the list's closest words by spelling, and these words; none beyond what is allowed.

        Candidates share enough pairs of letters: one edit, a swap of neighbours included, spoils three at most.
        """
        found = self._spelt.get(token)
        if found is None:
            if len(self._spelt) > 300_000:
                self._spelt.clear()
            found = self._spelt[token] = (0, frozenset([token])) if token in self.known else self._closest(token)
        return found

    def _closest(self, token: str) -> tuple[int, frozenset[str]]:
        most = allowed(token)
        hits = [self.postings[g] for g in grams([token], 2) if g in self.postings]
        if not most or not hits:
            return 3, frozenset()
        words, shared = np.unique(np.concatenate(hits), return_counts=True)
        size = self.length[words]
        pairs = len(grams([token], 2))
        near = (np.abs(size - len(token)) <= most) & (shared >= np.maximum(1, pairs - 3 * most))
        best, found = most, []
        for i in words[near]:
            w = self.vocabulary[i]
            e = edits(token, w, best)
            if e <= min(best, allowed(w)):
                found = [w] if e < best else [*found, w]
                best = e
        return (best, frozenset(found)) if found else (3, frozenset())


class GramIndex:
    """Inverted index of character n-grams over the forms (names and aliases) of a block of entries."""

    def __init__(self, entries: list[Entry], statistics: ListStatistics | None = None) -> None:
        self.statistics = statistics or ListStatistics(entries)
        self.ids: list[int] = []
        self.words: list[list[str]] = []
        for ref, words in forms_of(entries):
            self.ids.append(ref)
            self.words.append(words)
        self.weights: list[dict[str, float]] = []
        postings: dict[str, tuple[list[int], list[float]]] = defaultdict(lambda: ([], []))
        for form, words in enumerate(self.words):
            self.weights.append(self._unit(grams(words)))
            for g, w in self._unit(sought(words)).items():
                postings[g][0].append(form)
                postings[g][1].append(w)
        self.postings = {g: (np.array(f, np.int64), np.array(w)) for g, (f, w) in postings.items()}

    def _unit(self, counts: dict[str, int]) -> dict[str, float]:
        """N-grams, each by its count and rarity, as a vector of length one."""
        idf = self.statistics.idf
        rarest = max(idf.values(), default=1.0)
        own = {g: c * idf.get(g, rarest) for g, c in counts.items()}
        size = sum(w * w for w in own.values()) ** 0.5
        return {g: w / size for g, w in own.items()}

    def retrieve(self, tokens: list[str]) -> list[int]:
        """Forms whose n-grams are like the typed ones: by weighted cosine, over the postings of these n-grams only."""
        hits = [(self.postings[g], w) for g, w in self._unit(sought(tokens)).items() if g in self.postings]
        if not hits:
            return []
        forms = np.concatenate([f for (f, _), _ in hits])
        scores = np.concatenate([x * w for (_, x), w in hits])
        found, where = np.unique(forms, return_inverse=True)
        total = np.bincount(where, scores)
        return found[total >= max(RETRIEVE, RETRIEVE_SHARE * float(total.max()))].tolist()

    def reading(self, tokens: list[str], form: list[str], others: list[str]) -> list[str]:
        """The typed words as words of the list, a word of the form wherever one may be meant, else one of the
        `others` that were retrieved; words unlike all are left out."""
        out: list[str] = []
        names = self.statistics
        have = set(form)
        shortened = lambda t, ws: [w for w in ws if (w in names.generic or not names.generic) and abbreviates(t, w)][:1]
        for t in tokens:
            distance, close = names.spelt(t)
            if t in have:
                out.append(t)
            elif t in LEGAL_FORMS and distance:
                continue
            elif distance == 0:
                out.append(next((w for w in form if len(t) > 3 and w.startswith(t)), t))
            elif close & have:
                out += close & have
            elif len(form) > 3 and t == "".join(w[0] for w in form[2:]) and names.generic.issuperset(form[2:]):
                out += form[2:]
            elif distance == 1:
                out.append(min(close))
            else:
                # where some words only describe, the others, which are names, are not abbreviated
                pair = next(((x, y) for x, y in zip(form, form[1:]) if len(t) >= 7 and edits(t, x + y, 2) <= min(2, allowed(x) + allowed(y))), None)
                out += shortened(t, form) or pair or shortened(t, others) or sorted(close)[:1]
        return out

    def match(self, text: str) -> tuple[int, float, float]:
        """(id, score, score of the best other id); id 0 where nothing is meant."""
        tokens = tokens_of(text)
        top: dict[int, float] = {}
        retrieved = self.retrieve(tokens) if tokens else []
        others = sorted({w for form in retrieved for w in self.words[form]})
        for form in retrieved:
            words = self.reading(tokens, self.words[form], others)
            if words and self.whole(words, self.words[form]):
                own = self.weights[form]
                score = sum(w * own.get(g, 0.0) for g, w in self._unit(grams(words)).items())
                if score >= THRESHOLD - MARGIN:
                    ref = self.ids[form]
                    top[ref] = max(top.get(ref, 0.0), score)
        order = sorted(top.items(), key=lambda x: (-x[1], x[0]))
        if not order:
            return 0, 0.0, 0.0
        second = order[1][1] if len(order) > 1 else 0.0
        good = order[0][1] >= THRESHOLD and order[0][1] - second >= MARGIN
        return (order[0][0] if good else 0), order[0][1], second

    def whole(self, words: list[str], form: list[str]) -> bool:
        """Whether every word of the form that tells entries apart is among the typed words."""
        have = set(words)
        return all(w in have for w in form if w not in self.statistics.generic)


def _match_values(batches: Iterator[pa.RecordBatch], index: GramIndex) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, scores, seconds = zip(*map(index.match, batch.column(0).to_pylist())) if batch.num_rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ids, pa.int32()), pa.array(scores, pa.float64()), pa.array(seconds, pa.float64())],
            ["value", "ref_id", "score", "second"],
        )


def map_values(values: DataFrame, value: str, reference: DataFrame, ref_id: str, name: str, aliases: str | None = None, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(`value`, `ref_id`, `score`, `second`) of each distinct non-blank value; `ref_id` 0: unmatched.

    Null and blank values give no rows; entries with a null or blank name and no alias are never
    meant; an empty list leaves all unmatched; entries of two ids with one name are a tie, which is
    unmatched; very long values are read whole. Other columns are not read.

    Values are deduplicated before anything else. What words and n-grams weigh is counted over the whole
    list; the list is then read in blocks of `block_entries`, each broadcast as an index, used on all
    values, written and released before the next. The best of all blocks counts, under the same threshold
    and margin, so the answer does not depend on the blocks. The statistics grow with the different words
    of the list, which is a list of names, not with the values.
    """
    distinct = values.select(F.col(value).alias("value")).where(F.regexp_like("value", F.lit(r"\S"))).distinct()
    # few bytes a value, but much work: a fixed number of partitions, which AQE doesn't coalesce. By the
    # value itself the exchange would be merged with that of the distinct, which it does coalesce.
    distinct = distinct.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("value"))
    columns = [F.col(ref_id).cast("int"), F.col(name), F.col(aliases) if aliases else F.array().cast("array<string>")]
    spark, parts = values.sparkSession, []
    entries = reference.select(*columns)
    statistics = ListStatistics(e for block in _blocks(entries, block_entries) for e in block)
    blocks = _blocks(entries, block_entries)
    block, following = next(blocks, None), next(blocks, None)
    while block:
        sent = spark.sparkContext.broadcast(GramIndex(block, statistics))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            return _match_values(batches, sent.value)

        part = distinct.mapInArrow(run, "value string, ref_id int, score double, second double")
        if following or parts:
            part = materialise(part, "matches")
            sent.destroy()
        parts.append(part)
        block, following = following, next(blocks, None)
    if not parts:
        return distinct.select("value", F.lit(0).alias("ref_id"), F.lit(0.0).alias("score"), F.lit(0.0).alias("second"))
    if len(parts) == 1:
        return parts[0]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    best = union.groupBy("value").agg(
        F.max(F.struct("score", "ref_id")).alias("b"),
        F.slice(F.sort_array(F.collect_list("score"), asc=False), 2, 1).alias("other"),  # one number a block
        F.max("second").alias("second"),
    )
    second = F.greatest(F.coalesce(F.get("other", F.lit(0)), F.lit(0.0)), F.when(F.col("second") < F.col("b.score"), F.col("second")))
    return best.select("value", "b.ref_id", "b.score", second.alias("second")).withColumn(
        "ref_id", F.when(F.col("score") - F.col("second") >= MARGIN, F.col("ref_id")).otherwise(0)
    )


def _blocks(reference: DataFrame, size: int) -> Iterator[list[tuple[int, str, list[str]]]]:
    block = []
    for ref, name, aliases in reference.toLocalIterator():
        block.append((ref, name, [a for a in aliases or [] if a]))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = load(spark, sf_dir, "employment")
    fields = (
        ("employer", "employer_raw", "employer_canonical", load(spark, sf_dir, "employers"), "employer_id", "employer_canonical"),
        ("title", "title", "seniority_level", load(spark, sf_dir, "titles"), "title_id", "title_canonical"),
    )
    out = None
    for field, typed, known, reference, ref_id, name in fields:
        cases = roles.where(F.col(known).isNull() & F.regexp_like(typed, F.lit(r"\S"))).select("candidate_id", "seq", F.col(typed).alias("value")).distinct()
        mapped = map_values(cases, "value", reference, ref_id, name, "aliases").select("value", "ref_id")
        part = cases.join(mapped, "value").select("candidate_id", "seq", F.lit(field).alias("field"), "ref_id")
        out = part if out is None else out.unionByName(part)
    return out.distinct()
