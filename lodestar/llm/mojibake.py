"""Text read with the wrong character encoding: found, and restored where that is possible.

A multinomial classifier on hashed byte bigrams, trained on synthetically garbled words, names the
encoding chain of every word with a letter outside ASCII. The best stretch of words of each chain is
weighed against their being clean; its chain is then inverted under strict decoding, which also
verifies the finding. Words are scored once a process, as few are different.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import load

#: Texts the classifier is trained on, drawn by a hash of their key: the bound of the labelled sample.
TRAIN_TEXTS = 2_000
#: Longer texts stay out of the labelled sample, and only there.
TRAIN_CHARS = 50_000
BUCKETS = 1 << 15
SMOOTHING = 0.02
#: Log likelihood by which a stretch must be likelier garbled than clean.
THRESHOLD = 7.0
LOST = "lost"

#: Fixed values: (encoding of the bytes, encoding they were read in, times) of each chain.
CHAINS: list[tuple[str, str, int]] = [
    ("utf-8", "latin-1", 1),
    ("utf-8", "cp1252", 1),
    ("utf-8", "cp1252", 2),
    ("utf-8", "latin-1", 2),
    ("utf-8", "mac_roman", 1),
    ("utf-8", "cp437", 1),
    ("utf-8", "cp850", 1),
    ("utf-8", "cp1250", 1),
    ("utf-8", "cp1251", 1),
    ("utf-8", "cp1253", 1),
    ("utf-8", "cp1254", 1),
    ("utf-8", "iso8859-2", 1),
    ("utf-8", "koi8-r", 1),
    ("utf-8", "cp866", 1),
    ("mac_roman", "cp1252", 1),
    ("cp1252", "mac_roman", 1),
    ("cp1252", "cp1251", 1),
    ("cp1252", "cp1250", 1),
    ("cp1252", "cp437", 1),
    ("cp1252", "cp850", 1),
    ("cp437", "cp1252", 1),
    ("cp850", "cp1252", 1),
    ("cp1252", LOST, 1),
]

#: Clean words with signs that look garbled: foreign names, letters and signs written as meant.
FOREIGN = (
    "Þór Ð ð Þ Ð, Þ, ß æ Łódź Żywiec Gdańsk İzmir Iğdır Žilina Plzeň Škoda Győr Ångström Øre Ø Ærø São João Ñandú Ñ "
    "Γειά σου κόσμε Αθήνα рынок облигаций Москва это дом Київ 东京 香港 한국어 日本語 "
    "€ £ ¥ ₿ €5 £30 ¥200 √2 √ ≈ ± ½ ¼ ¾ ∑ ∞ ≤ ≥ ≠ ∂ ∫ π µ ° 20° 5′ 10″ § §5 ¶ † ‡ • · – — … ‰ ™ ® © ª º 1º 2ª "
    "« » “a” ‘b’ „c“ ├── └── │ ─ ┌ ┐ ✉ ☎ ✓ → ← ¿qué ¡no ÀÉÎÕÜ ÇA Ô Ê È"
).split()


@lru_cache(maxsize=None)
def _table(encoding: str) -> list[str]:
    """Characters of the 256 bytes; bytes without one stand for the control character of their number."""
    return [bytes([b]).decode(encoding, "replace").replace("�", chr(b)) for b in range(256)]


#: A run of characters outside ASCII.
WIDE = re.compile(r"[^\x00-\x7f]+")
ASCII_LETTER = re.compile(r"[A-Za-z]")
#: Signs that stand alone between words; one that makes up this share of the sample is common.
SIGNS = "–—•·✉…"
COMMON_SIGN = 0.002


def bare(word: str) -> str:
    """A word in lower case without what may stand around it; a sign by itself stays."""
    return word.lower().strip(".,;:!?()[]{}'\"|/*“”‘’«»-") or word


@dataclass(frozen=True)
class Chain:
    source: str
    read: str
    times: int

    @property
    def name(self) -> str:
        return f"{self.source}>{self.read}" + (f"x{self.times}" if self.times > 1 else "")

    def garble(self, text: str) -> str:
        for _ in range(self.times):
            if self.read == LOST:
                return "".join(c if c.isascii() else "�" for c in text)
            table = _table(self.read)
            out = []
            for c in text:
                try:
                    out.append("".join(table[b] for b in c.encode(self.source)))
                except UnicodeEncodeError:
                    out.append(c)
            text = "".join(out)
        return text

    def restore(self, text: str) -> str | None:
        """The text before the chain, or None where strict decoding fails."""
        if self.read == LOST:
            return None
        back = _inverse(self.read)
        for _ in range(self.times):
            try:
                text = bytes(back[c] for c in text).decode(self.source, "strict")
            except (KeyError, UnicodeDecodeError):
                return None
        return text


_inverses: dict[str, dict[str, int]] = {}


def _inverse(encoding: str) -> dict[str, int]:
    if encoding not in _inverses:
        _inverses[encoding] = {c: b for b, c in reversed(list(enumerate(_table(encoding))))}
    return _inverses[encoding]


#: Garbled letters may hold these, at which str.split cuts too; they are kept in the word by stand-ins.
_CUTS = "\xa0\x85\x1c\x1d\x1e\x1f\u2028\u2029"
_HELD = str.maketrans(_CUTS, "".join(chr(0xF8F0 + i) for i in range(len(_CUTS))))
_FREED = {v: chr(k) for k, v in _HELD.items()}
_CUT = re.compile(f"[{_CUTS}]")


def wide_words(text: str) -> list[str]:
    """Words, between blanks, that hold a character outside ASCII."""
    if _CUT.search(text):
        return [w.translate(_FREED) for w in text.translate(_HELD).split() if not w.isascii()]
    return [w for w in text.split() if not w.isascii()]


def features(word: str) -> list[int]:
    """Hashed byte bigrams, with a byte outside ASCII, of a word between blanks. Digits count as one."""
    data = re.sub(rb"[0-9]", b"0", b" " + word.encode("utf-8", "surrogatepass") + b" ")
    return [((a * 257 + b) * 2654435761 >> 7) % BUCKETS for a, b in zip(data, data[1:]) if a > 127 or b > 127]


class Classifier:
    """Log likelihoods of every chain over clean, by bigram."""

    def __init__(self, words: Counter, chains: list[Chain]) -> None:
        self.chains = chains
        self._strictly: dict[str, bool] = {}
        for _ in range(2):  # the second time without what the first finds garbled
            self._fit(words)
            words = Counter({w: n for w, n in words.items() if self.score(w)[0].max() < THRESHOLD and not self._strict(w)})
        self._fit(words)
        total = sum(words.values())
        self.attested = {bare(w) for w, n in words.items() if ASCII_LETTER.search(w) and not self._strict(w) and "�" not in w}
        self.signs = {bare(w) for w, n in words.items() if not ASCII_LETTER.search(w) and n >= COMMON_SIGN * total} & set(SIGNS)

    def _fit(self, words: Counter) -> None:
        clean = Counter(words)
        for w in FOREIGN:
            clean[w] += 3
        counts = np.zeros((len(self.chains) + 1, BUCKETS))
        for w, n in clean.items():
            if "�" in w or (self._strict(w) and w not in FOREIGN):
                continue
            n = n**0.75  # common words say little more than others
            np.add.at(counts[0], features(w), n)
            for k, chain in enumerate(self.chains, 1):
                np.add.at(counts[k], features(chain.garble(w)), n)  # words that stay as they are count too
        seen = counts.sum(axis=0) > 0
        rate = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * seen.sum())
        self.log = np.log(rate).astype(np.float32)
        self.log[:, ~seen] = 0
        self.cache: dict[str, tuple[np.ndarray, bool]] = {}

    def _strict(self, word: str) -> bool:
        if word not in self._strictly:
            self._strictly[word] = any(self._decodes(c, word) for c in self.chains if c.source == "utf-8")
        return self._strictly[word]

    @staticmethod
    def _decodes(chain: Chain, word: str) -> bool:
        """Whether a part of the word outside ASCII is strictly what the chain makes of something shorter."""
        return any((r := chain.restore(part)) is not None and len(r) < len(part) for part in WIDE.findall(word))

    def score(self, word: str) -> tuple[np.ndarray, bool]:
        """Each chain's log likelihood over clean, and whether any is more than slightly positive."""
        known = self.cache.get(word)
        if known is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
            f = features(word)
            total = self.log[:, f].sum(axis=1)
            vector = total[1:] - total[0]
            for k, chain in enumerate(self.chains):  # what a chain leaves as it is says nothing for it
                if vector[k] > 0 and all(chain.restore(part) == part for part in WIDE.findall(word)):
                    vector[k] = 0
            known = self.cache[word] = (vector, bool((vector > 1).any()))
        return known

    def __getstate__(self) -> dict:
        return {"chains": self.chains, "log": self.log, "attested": self.attested, "signs": self.signs}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"cache": {}}

    def find(self, text: str) -> tuple[Chain, float] | None:
        """The likeliest chain of the text's likeliest garbled stretch, and the log likelihood over clean."""
        return next(((chain, score) for chain, score, _, _ in self.chains_of(text)), None)

    def chains_of(self, text: str) -> Iterator[tuple[Chain, float, int, int]]:
        """Every verified chain with its log likelihood over clean, the likeliest first, and its stretch: the
        first and the last of its wide words."""
        words = wide_words(text)
        scored = [self.score(w) for w in words]
        if not any(s for _, s in scored):
            return
        run = np.cumsum(np.stack([v for v, _ in scored]), axis=0)
        low = np.minimum.accumulate(np.vstack([np.zeros(run.shape[1], run.dtype), run[:-1]]), axis=0)
        best = (run - low).max(axis=0)
        for k in np.argsort(-best):
            if best[k] < THRESHOLD:
                return
            chain = self.chains[k]
            end = int((run - low)[:, k].argmax())
            begin = int(np.flatnonzero(np.append(0, run[:end, k]) == low[end, k])[-1]) if end else 0
            stretch = words[begin : end + 1]
            if self.verified(chain, stretch):
                yield chain, float(best[k]), begin, end

    def verified(self, chain: Chain, words: list[str]) -> bool:
        """Strict decodability. A chain from UTF-8 must decode some word; as the others decode nearly
        anything, all words must decode, be likelier clean then, and mostly be words of the clean sample."""
        if chain.read == LOST:
            return any("�" in w for w in words)
        if chain.source == "utf-8":
            return any(self._decodes(chain, w) for w in words)
        gain, known, signs, unknown = 0.0, 0, set(), 0
        for w in words:
            r = chain.restore("".join(WIDE.findall(w)))
            if r is None:
                return False
            r = WIDE.sub(lambda m: chain.restore(m[0]), w)
            if r == w:
                continue
            gain += float(self.log[0, features(r)].sum() - self.log[0, features(w)].sum())
            if bare(r) in self.attested:
                known += 1
            elif bare(r) in self.signs:
                signs.add(bare(r))
            else:
                unknown += 1
        return gain > 0 and (known > 0 or len(signs) > 1) and known + len(signs) >= unknown

    def repair(self, text: str) -> tuple[str, list[str]]:
        """The text with every stretch restored whose chain can be inverted, and the chains used."""
        used: list[str] = []
        seen = {text}  # each round gives a text not seen before, so it ends
        while True:
            for chain, _, first, last in self.chains_of(text):
                if chain.read == LOST:  # the letters of this stretch are gone, those of others may not be
                    continue
                fixed = self._restored(chain, text, first, last)
                if fixed not in seen:
                    break
            else:
                return text, used
            text = fixed
            seen.add(text)
            used.append(chain.name)

    def _restored(self, chain: Chain, text: str, first: int, last: int) -> str:
        """The text with the words that speak for the chain inverted: those of the verified stretch, and, as
        strict decodability from UTF-8 verifies a word by itself, such words wherever they stand."""
        out, done, nth, k = [], 0, 0, self.chains.index(chain)
        for m in re.finditer(r"\S+", text.translate(_HELD)):
            if m[0].isascii():
                continue
            word = text[m.start() : m.end()]
            inside = first <= nth <= last or (chain.source == "utf-8" and self._decodes(chain, word))
            nth += 1
            if inside and self.score(word)[0][k] > 0:
                out += [text[done : m.start()], WIDE.sub(lambda x: chain.restore(x[0]) or x[0], word)]
                done = m.end()
        return "".join([*out, text[done:]])


def train(df: DataFrame, key: str, text: str, texts: int = TRAIN_TEXTS) -> Classifier:
    """Fit on the words of at most about `texts` texts, drawn by a hash of the key over the whole table."""
    rows = df.count()
    every = max(1, rows // texts)
    drawn = df.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).where(F.length(text).between(1, TRAIN_CHARS)).select(text).limit(2 * texts)
    words: Counter = Counter()
    for (t,) in drawn.toLocalIterator():
        words.update(wide_words(t))
    return Classifier(words, [Chain(*c) for c in CHAINS])


def find_garbled(df: DataFrame, key: str, text: str, classifier: Classifier | None = None) -> DataFrame:
    """(`key`, `chain`, `score`, `restored`, `chains`) of every text with a garbled stretch.

    `restored` is the text with what could be inverted restored, NULL where nothing could be. Null
    and empty texts and texts of ASCII are never garbled; repeated rows repeat; a null key stays null;
    no rows give no rows; texts are read whole. Rows are independent: nothing is shuffled. Other
    columns are not read.
    """
    model = classifier or train(df, key, text)
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            where, out = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                found = own.find(t)
                if found:
                    restored, used = own.repair(t)
                    where.append(i)
                    out.append((found[0].name, found[1], restored if restored != t else None, used))
            if out:
                types = [pa.string(), pa.float64(), pa.string(), pa.list_(pa.string())]
                columns = [batch.column(0).take(pa.array(where)), *(pa.array(c, x) for c, x in zip(zip(*out), types))]
                yield pa.RecordBatch.from_arrays(columns, ["k", "chain", "score", "restored", "chains"])

    return rows.mapInArrow(run, f"k {kind}, chain string, score double, restored string, chains array<string>").withColumnRenamed("k", key)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_garbled(load(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id").distinct()


def p3_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every affected document with its chains and its restored text."""
    return find_garbled(load(spark, sf_dir, "documents"), "doc_id", "text")
