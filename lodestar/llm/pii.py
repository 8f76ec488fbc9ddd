"""Personal information in free text: found by a character-level LSTM with CRF, replaced by placeholders.

Every character of every text is read in overlapping windows; where two overlap, their emissions are
blended, and one Viterbi path over the whole text then gives the spans. No pattern proposes, vetoes or
replaces a span: what follows only completes words that a span cuts, strips marks at its ends and drops
what cannot be of its type at all (a phone number of four digits). The network is trained on spans
labelled in a bounded sample and on phrases with invented values (see `pii_labels`).
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import load
from .gru import Adam
from .lstm_crf import LstmCrf
from .models import digest, trained
from .pii_labels import TYPES, NameForms, form_spans, variant

#: Texts of each table, and known names, that the labelled sample holds at most about.
TRAIN_TEXTS, TRAIN_NAMES = 900, 4_000
#: Longer texts stay out of the labelled sample, and only there.
TRAIN_CHARS = 50_000
EPOCHS, BATCH, RATE = 6, 96, 1e-2
HIDDEN = 20
#: Characters of a window, and of the blend where two meet.
WINDOW, BLEND = 384, 32
STRIDE = WINDOW - BLEND
#: Characters of a training window.
TRAIN_WINDOW = 80
#: Share of the training windows without a span that are drawn, beside those the network gets wrong.
DRAWN = 0.12
WORDS = 1 << 14
CHUNK = 1 << 19
#: Windows run through the network at once.
RUN = 2048

# ------------------------------------------------------------------ characters

_LETTER = 1
_SIZE = 0x3000
CHARS = 256
PAD_CHAR, NEWLINE = 255, 10


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: kind, id, and a number of the letter in lower case."""
    kind, ids, low = np.zeros(_SIZE + 1, np.uint8), np.full(_SIZE + 1, 254, np.uint8), np.zeros(_SIZE + 1, np.uint64)
    rng = np.random.default_rng(99)
    numbers = rng.integers(1, 2**63, _SIZE + 1, dtype=np.uint64) | np.uint64(1)
    for cp in range(_SIZE):
        c = chr(cp)
        if c.isalpha() or c in "'’":
            kind[cp] |= _LETTER
        lower = c.lower()
        low[cp] = numbers[ord(lower) if len(lower) == 1 and ord(lower) < _SIZE else cp]
        base = unicodedata.normalize("NFKD", c)[:1]
        if cp < 128:
            ids[cp] = ord("0") if c.isdigit() else cp
        elif base.isascii() and base.isalpha():
            ids[cp] = 128 + ord(base) % 64
        elif c.isalpha():
            ids[cp] = 192 + cp % 32
        else:
            ids[cp] = 224 + cp % 30
    ids[ord("\r")] = NEWLINE
    return kind, ids, low


KIND, CHAR_ID, LOW = _tables()
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


class Encoded:
    """A batch of texts as arrays: kinds, ids, words and their places."""

    def __init__(self, texts: list[str]) -> None:
        self.begin = np.cumsum([0, *(len(t) + 2 for t in texts)])
        self.length = np.array([len(t) for t in texts], np.int64)
        joined = "\n\n".join([*texts, ""])
        cp = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), _SIZE)
        self.kind, self.ids = KIND[cp], CHAR_ID[cp]
        letter = (self.kind & _LETTER).astype(np.int8)
        edge = np.diff(letter, prepend=0, append=0)
        self.first, self.last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _power(len(cp) + 1)
        total = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(np.where(letter > 0, LOW[cp], 0).astype(np.uint64) * up[: len(cp)], out=total[1:])
        h = (total[self.last] - total[self.first]) * down[self.first]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        self.word = ((h >> np.uint64(40)) % np.uint64(WORDS - 1) + np.uint64(1)).astype(np.int32)  # 0: no word
        self.word_of = np.zeros(len(cp), np.int32)
        self.word_of[letter > 0] = np.repeat(self.word, self.last - self.first)

    def segments(self, window: int = WINDOW, blend: int = BLEND) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begins and sizes of overlapping windows over each text by itself, and the text of each."""
        per = np.where(self.length > 0, 1 + np.maximum(0, -(-(self.length - window) // (window - blend))), 0)
        owner = np.repeat(np.arange(len(self.length)), per)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        begin = self.begin[owner] + nth * (window - blend)
        # a window goes on from the one before by `blend`, so the last is longer than that
        return begin, np.minimum(window, self.begin[owner] + self.length[owner] - begin), owner

    def cut(self, starts: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, words and places (time × batch) of windows; what lies outside the own text is padding, at place -1."""
        where = starts[None, :] + np.arange(window)[:, None]
        begin = self.begin[owner]
        inside = (where >= begin[None, :]) & (where < (begin + self.length[owner])[None, :])
        clipped = np.where(inside, where, 0)
        return np.where(inside, self.ids[clipped], PAD_CHAR), np.where(inside, self.word_of[clipped], 0), np.where(inside, where, -1)


# ------------------------------------------------------------------ the tagger


#: What the characters weigh where a window blends with the one before.
_RAMP = (np.arange(1, BLEND + 1, dtype=np.float32) / (BLEND + 1))[:, None]


class Tagger:
    """The trained network."""

    def __init__(self, net: LstmCrf) -> None:
        self.net = net

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> Tagger:
        net = LstmCrf(1 + len(TYPES), CHARS, 1, HIDDEN)
        net.p = arrays
        return cls(net)

    def emissions(self, enc: Encoded) -> np.ndarray:
        """Of every character, blended from the windows that hold it."""
        total = np.zeros((len(enc.ids), self.net.tags), np.float32)
        begin, size, owner = enc.segments()
        order = np.argsort(-size, kind="stable")
        follows = begin > enc.begin[owner]
        goes_on = begin + size < enc.begin[owner] + enc.length[owner]
        for i in range(0, len(order), RUN):
            own = order[i : i + RUN]
            b, n = begin[own], size[own]
            e = self.net.emissions(enc.ids, enc.word_of, b, n)
            start = 0
            for at, m, after, before in zip(b.tolist(), n.tolist(), follows[own].tolist(), goes_on[own].tolist()):
                part = e[start : start + m]
                if after:
                    part[:BLEND] *= _RAMP
                if before:
                    part[-BLEND:] *= _RAMP[::-1]
                total[at : at + m] += part
                start += m
        return total

    def tags(self, enc: Encoded) -> np.ndarray:
        e = self.emissions(enc)
        outside = np.ones(len(e), bool)
        for b, n in zip(enc.begin, enc.length):
            outside[b : b + n] = False
        e[outside] = 0
        e[outside, 0] = 1e4  # between texts there is nothing
        return self.net.path(e)

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, type) of each text."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        enc = Encoded(texts)
        tags = self.tags(enc)
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(tags)) + 1, [len(tags)]])
        kinds = tags[bounds[:-1]]
        for j in np.flatnonzero(kinds):
            d = int(np.searchsorted(enc.begin, bounds[j], "right") - 1)
            b = int(enc.begin[d])
            out[d].append((int(bounds[j]) - b, int(bounds[j + 1]) - b, TYPES[int(kinds[j]) - 1]))
        return [tidied(t, s) if s else [] for t, s in zip(texts, out)]


_EDGE = " \t\r\n\xa0,;:|/()[]{}<>\"“”«»•·✉—–*-'’"
#: What a span of each type may hold at its ends beside letters and digits.
_AT_START = {"email": "", "phone": "+(", "id": "", "address": ""}
_AT_END = {"email": "", "phone": "", "id": "", "address": "ºª°"}
#: Characters at which no word of the type ends.
_INSIDE = {"email": "._%+-@", "phone": "", "id": "", "address": "'’"}
#: Least and most digits of a span of each type.
_DIGITS = {"email": (0, 99), "phone": (7, 15), "id": (4, 14), "address": (1, 20)}


def tidied(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans with whole words and without marks at their ends; impossible ones are dropped.

    Parts of a name that only blanks, commas or points part are one span, and parts of an address for
    mail that only marks part; where two spans come to overlap, a name gives way, else the later one.
    """
    kept: list[tuple[int, int, str]] = []
    names: list[list[int]] = []
    joined: list[tuple[int, int, str]] = []
    for a, b, kind in spans:
        if joined and kind == joined[-1][2] == "email" and a - joined[-1][1] <= 3 and not any(map(str.isalnum, text[joined[-1][1] : a])):
            joined[-1] = (joined[-1][0], b, kind)
        else:
            joined.append((a, b, kind))
    for a, b, kind in joined:
        if kind == "name":
            if names and a - names[-1][1] <= 3 and not text[names[-1][1] : a].strip(" .,\xa0"):
                names[-1][1] = b
            else:
                names.append([a, b])
            continue
        if kind == "email" and (m := _PLAIN.search(text, a, b)):  # no blank stands in it, so words before it are no part
            if names and a - names[-1][1] <= 1 and m.start() > a:
                names[-1][1] = m.start()
            a, b = m.span()
        s = _whole(text, a, b, kind)
        if s:
            if kept and s[0] < kept[-1][1]:
                if kept[-1][2] == kind:
                    kept[-1] = (kept[-1][0], max(kept[-1][1], s[1]), kind)
                continue
            kept.append(s)
    for a, b in names:
        for x, y, _ in kept:
            if x <= a < y:
                a = y
            elif a < x < b:
                b = x
        lower = max([0, *(y for _, y, _ in kept if y <= a)])
        s = fit_name(text, a, b, lower) if b > a else None
        if s and all(s[1] <= x or s[0] >= y for x, y, _ in kept):
            kept.append(s)
    return sorted(s for s in set(kept) if s[2] != "email" or _AT.search(text, s[0], s[1]))


#: Short words for kinds of streets, to which a point belongs.
_SHORT = re.compile(r"\b(?:St|Rd|Ave|Ln|Ct|Dr|Pl|Sq)\Z", re.I)
#: An undisguised address for mail: what stands without a blank around the sign.
_PLAIN = re.compile(r"[^\s()<>]+@[^\s()<>]+")
#: Fixed value: what stands for the sign that every address for mail has.
_AT = re.compile(r"[@＠]|\bat\b", re.I)


def _one_line(text: str, a: int, b: int) -> tuple[int, int]:
    """The longest line of a span."""
    part = text[a:b]
    if "\n" in part or "\r" in part:
        longest = max(re.split(r"[\r\n]+", part), key=len)
        a += part.index(longest)
        b = a + len(longest)
    return a, b


def _whole(text: str, a: int, b: int, kind: str) -> tuple[int, int, str] | None:
    """The span with its words completed and its ends stripped, or None where it cannot be of its type."""
    a, b = _one_line(text, a, b)
    while a < b and not (text[a].isalnum() or ord(text[a]) > 127 and not text[a].isspace() and text[a] not in _EDGE or text[a] in _AT_START[kind]):
        a += 1
    while b > a and not (text[b - 1].isalnum() or ord(text[b - 1]) > 127 and not text[b - 1].isspace() and text[b - 1] not in _EDGE or text[b - 1] in _AT_END[kind]):
        b -= 1
    if a == b:
        return None
    if kind == "phone":
        while a < b and not (text[a].isdigit() or text[a] in "+("):
            a += 1
        while b > a and not text[b - 1].isdigit():
            b -= 1
        while a > 0 and a < b and (text[a - 1].isdigit() or (text[a - 1] in "+(" and text[a].isdigit())):
            a -= 1
        while b < len(text) and text[b].isdigit():
            b += 1
    else:
        joins = _INSIDE[kind]
        part = lambda c: c.isalnum() or c in joins or (kind == "address" and _word_char(c))
        while a > 0 and part(text[a - 1]) and part(text[a]):
            a -= 1
        while b < len(text) and part(text[b]) and part(text[b - 1]) and not (text[b] in joins and (b + 1 == len(text) or not text[b + 1].isalnum())):
            b += 1
        if kind == "address" and text[b : b + 1] == "." and _SHORT.search(text, a, b):
            b += 1
        while kind == "email" and a < b and text[a] in joins:
            a += 1
    least, most = _DIGITS[kind]
    found = text[a:b]
    without = kind in ("email", "address") and not any(map(str.isalpha, found))
    without |= kind == "address" and len(found.split()) < 2
    return None if without or len(found) < 5 or not least <= sum(map(str.isdigit, found)) <= most else (a, b, kind)


def _word_char(c: str) -> bool:
    return c.isalnum() or c in "'’" or (ord(c) > 127 and not c.isspace() and c not in _EDGE)


def fit_name(text: str, a: int, b: int, lower: int = 0) -> tuple[int, int, str] | None:
    """A name of whole words, initials with their point, on one line: two words or more."""
    while a < b and text[a] in _EDGE + ".":
        a += 1
    while b > a and text[b - 1] in _EDGE + ".":
        b -= 1
    while a > lower and (_word_char(text[a - 1]) or (text[a - 1] == "-" and a > 1 and _word_char(text[a - 2]))):
        a -= 1
    while b < len(text) and (_word_char(text[b]) or (text[b] == "-" and b + 1 < len(text) and _word_char(text[b + 1]) and text[b + 1].isupper())):
        b += 1
    a, b = _one_line(text, a, b)
    part = text[a:b]
    words = re.findall(r"[^\W\d_][\w’'.\-]*", part)
    if len(words) < 2 or any(c.isdigit() for c in part) or "@" in part or "&" in part:
        return None
    if b < len(text) and text[b] == "." and re.search(r"(?:^|[ \xa0])[^\W\d_]$", part):
        b += 1
    return (a, b, "name")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by the placeholder of its type."""
    out, last = [], 0
    for a, b, kind in spans:
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*out, text[last:]])


# ------------------------------------------------------------------ training


def labelled(texts: list[str], names: NameForms) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts of the sample with their spans: known names, and the commonest written forms of the other types."""
    out = []
    for t in texts:
        spans = form_spans(t)
        spans += [s for s in names.spans(t) if all(s[1] <= k[0] or s[0] >= k[1] for k in spans)]
        out.append((t, sorted(spans)))
    return out


def fit(texts: list[str], full_names: list[str], epochs: int = EPOCHS, seed: int = 21) -> Tagger:
    """Train on the labelled spans of `texts` and on invented phrases."""
    rng = np.random.default_rng(seed)
    sample = labelled(texts, NameForms(full_names))
    net = LstmCrf(1 + len(TYPES), CHARS, WORDS, HIDDEN)
    adam = Adam(net.p, RATE)
    half = TRAIN_WINDOW // 3
    for epoch in range(epochs):
        windows: list[tuple[np.ndarray, ...]] = []
        order = rng.permutation(len(sample))
        for i in range(0, len(order), 200):
            varied = [variant(*sample[j], full_names, rng) for j in order[i : i + 200]]
            enc = Encoded([t for t, _ in varied])
            tag = np.zeros(len(enc.ids), np.int8)
            for (_, own), b in zip(varied, enc.begin):
                tag[b : b + len(own)] = own
            starts, _, owner = enc.segments(TRAIN_WINDOW, TRAIN_WINDOW // 3)
            starts = starts + rng.integers(-half, half + 1, len(starts))
            chars, words, where = enc.cut(starts, owner, TRAIN_WINDOW)
            gold = np.where(where >= 0, tag[np.maximum(where, 0)], 0)
            some = gold.any(axis=0)
            wrong = np.zeros(len(some), bool)
            if epoch:  # windows without a span where the network as it is sees one
                empty = np.flatnonzero(~some)
                found = np.append(0, np.cumsum(Tagger(net).emissions(enc).argmax(axis=1) > 0))
                a, z = (np.clip(starts[empty] + x, 0, len(enc.ids)) for x in (0, TRAIN_WINDOW))
                wrong[empty] = found[z] > found[a]
            # the rarer types count twice, addresses three times
            rare, place = np.flatnonzero((gold > 2).any(axis=0)), np.flatnonzero((gold == 1 + TYPES.index("address")).any(axis=0))
            use = np.concatenate([np.flatnonzero(some | wrong | (rng.random(len(starts)) < DRAWN)), np.flatnonzero(wrong), rare, place])
            words = np.where(rng.random(words.shape[1]) < 0.15, 0, words)  # some windows by letters alone
            windows.append((chars[:, use], words[:, use], gold[:, use]))
        chars, words, gold = (np.concatenate(x, axis=1) for x in zip(*windows)) if windows else (np.zeros((TRAIN_WINDOW, 0), int),) * 3
        mixed = rng.permutation(chars.shape[1])
        adam.rate = RATE * (1 - 0.85 * epoch / max(1, epochs - 1))
        for i in range(0, len(mixed), BATCH):
            pick = mixed[i : i + BATCH]
            _, grads = net.gradients(chars[:, pick], words[:, pick], gold[:, pick].astype(np.int64))
            adam.step(grads)
    return Tagger(net)


def _drawn(df: DataFrame, key: str, text: str, most: int) -> list[str]:
    """At most about `most` texts, by a hash of the key over the whole table."""
    every = max(1, df.count() // most)
    rows = df.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).where(F.length(text).between(1, TRAIN_CHARS)).select(key, text).limit(2 * most).collect()
    return [t for _, t in sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0]))]


def _full_name(payload: str) -> str | None:
    try:
        value = json.loads(payload)
        value = json.loads(value) if isinstance(value, str) else value
        value = value.get("data", value)["sensitive"]["full_name"]
        return value["value"] if isinstance(value, dict) else value
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


def known_names(candidates: DataFrame, most: int = TRAIN_NAMES) -> list[str]:
    """Names of people from a bounded sample of profiles."""
    found = map(_full_name, _drawn(candidates, "candidate_id", "payload", most))
    return sorted({n for n in found if isinstance(n, str) and n.strip()})


_SCHEMA = "pii_type string, pii_text string, char_start int, char_end int"


def _batches_of(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Texts in groups of about CHUNK characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, texts[start:]


def _once(texts: pa.Array) -> tuple[list[str], list[np.ndarray]]:
    """The different texts of an Arrow batch, and the rows of each: copies are read once."""
    encoded = texts.dictionary_encode()
    index = encoded.indices.to_numpy()
    rows = np.split(np.argsort(index, kind="stable"), np.cumsum(np.bincount(index, minlength=len(encoded.dictionary)))[:-1])
    return encoded.dictionary.to_pylist(), rows


def find_pii(df: DataFrame, key: str, text: str, tagger: Tagger) -> DataFrame:
    """(`key`, `pii_type`, `pii_text`, `char_start`, `char_end`) of every span.

    Null and empty texts have none; repeated rows repeat; null keys stay null; no rows give no rows;
    texts of any length are scanned whole. Rows are independent: nothing is shuffled. Other columns
    are not read.
    """
    sent = df.sparkSession.sparkContext.broadcast(tagger)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            once, rows_of = _once(batch.column(1))
            for start, texts in _batches_of(once):
                where, out = [], []
                for i, (t, spans) in enumerate(zip(texts, own.spans(texts)), start):
                    for row in rows_of[i].tolist() if spans else ():
                        where += [row] * len(spans)
                        out += [(k, t[a:b], a, b) for a, b, k in spans]
                if out:
                    types = [pa.string(), pa.string(), pa.int32(), pa.int32()]
                    columns = [batch.column(0).take(pa.array(where)), *(pa.array(c, x) for c, x in zip(zip(*out), types))]
                    yield pa.RecordBatch.from_arrays(columns, ["k", *(x.split()[0] for x in _SCHEMA.split(", "))])

    return rows.mapInArrow(run, f"k {kind}, {_SCHEMA}").withColumnRenamed("k", key)


def redact_texts(df: DataFrame, key: str, text: str, tagger: Tagger) -> DataFrame:
    """(`key`, `redacted`) of every row: null and empty texts as they are, all others with placeholders."""
    sent = df.sparkSession.sparkContext.broadcast(tagger)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out: list[str | None] = list(texts)
            some = np.array([i for i, t in enumerate(texts) if t], np.int64)
            once, rows_of = _once(batch.column(1).take(pa.array(some)))
            for start, part in _batches_of(once):
                for i, (t, spans) in enumerate(zip(part, own.spans(part)), start):
                    done = redact(t, spans)
                    for row in some[rows_of[i]].tolist():
                        out[row] = done
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["k", "redacted"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, redacted string").withColumnRenamed("k", key)


def train(documents: DataFrame, run_states: DataFrame, candidates: DataFrame) -> Tagger:
    """The tagger of a bounded sample of these tables; an equal sample is trained on only once (see `models`)."""
    texts = _drawn(documents, "doc_id", "text", TRAIN_TEXTS) + _drawn(run_states, "state_id", "raw_text", TRAIN_TEXTS)
    names = known_names(candidates)
    key = digest([*texts, *names], ("pii", "pii_labels", "lstm_crf", "gru", "graphs"))
    return Tagger.of(trained(documents.sparkSession, "pii", key, lambda: fit(texts, names).net.p))


def _tables_and_tagger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Tagger]:
    documents, states = load(spark, sf_dir, "documents"), load(spark, sf_dir, "run_states")
    return documents, states, train(documents, states, load(spark, sf_dir, "candidates"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, states, tagger = _tables_and_tagger(spark, sf_dir)
    parts = [
        find_pii(df, key, text, tagger).select(F.lit(table).alias("record_table"), F.col(key).alias("record_id"), "pii_type", "pii_text")
        for df, key, text, table in ((documents, "doc_id", "text", "documents"), (states, "state_id", "raw_text", "run_states"))
    ]
    return parts[0].unionByName(parts[1]).distinct()


def p7_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of both tables with typed placeholders."""
    documents, states, tagger = _tables_and_tagger(spark, sf_dir)
    parts = [
        redact_texts(df, key, text, tagger).select(F.lit(table).alias("record_table"), F.col(key).alias("record_id"), "redacted")
        for df, key, text, table in ((documents, "doc_id", "text", "documents"), (states, "state_id", "raw_text", "run_states"))
    ]
    return parts[0].unionByName(parts[1])
