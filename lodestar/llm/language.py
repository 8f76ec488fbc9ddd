"""The language of every document and of every passage of mixed ones, with a confidence.

A bidirectional gated recurrent network over bytes labels every byte, and the bytes of a word together
give the word's; the labels of a document are smoothed by the likeliest path under a cost for changing the language; passages are the path's runs,
and the document's probabilities are pooled from its words. Words that all languages share, such as
names and titles, get no clear label and so end no passage and begin none.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import load
from . import graphs
from .gru import Adam, ByteGRU
from .models import digest, trained

LANGUAGES = ["en", "fr", "de", "es", "pt", "it"]

#: Other spellings of the languages' labels; regions after `-` or `_` are cut off.
SPELLINGS = {
    "en": "en eng english anglais englisch inglés inglês inglese",
    "fr": "fr fra fre french français francais französisch francés francês francese",
    "de": "de deu ger german deutsch allemand alemán alemão tedesco",
    "es": "es spa spanish español espanol castellano espagnol spanisch espanhol spagnolo",
    "pt": "pt por portuguese português portugues portugais portugiesisch portugués portoghese",
    "it": "it ita italian italiano italien italienisch",
}

#: Labelled texts of each language that the network is trained on: the bound of the labelled sample.
TRAIN_TEXTS = 220
#: Longer texts stay out of the labelled sample, and only there.
TRAIN_CHARS = 50_000
MIN_WORDS = 25
#: Classes: the languages, and any other.
NAMES = [*LANGUAGES, "other"]
CLASSES = len(NAMES)
#: Bytes of a segment, and of those on each side that only give context; segments run at once.
SEGMENT, CONTEXT, RUN = 480, 24, 2048
#: Log cost of changing the language between two words.
SWITCH = 9.0
#: Log probability over the second best from which a word is clearly of its language.
CLEAR = 3.0
HIDDEN = 16
#: Bytes of text labelled at once.
GROUP_BYTES = 1 << 21
#: Batches of training, their windows, and the bytes of a window.
BATCHES, BATCH, TRAIN_WINDOW, RATE = 240, 128, 160, 1e-2
#: Share of the training windows that are made of no known language.
OTHER_SHARE = 0.06


def known_language(label: Column) -> Column:
    """One of LANGUAGES for a label in any spelling, else NULL."""
    text = F.lower(F.trim(label))
    whole = {s: code for code, names in SPELLINGS.items() for s in names.split()}
    head = F.regexp_extract(text, r"^([^\-_ ]+)", 1)
    table = F.create_map(*[F.lit(x) for pair in whole.items() for x in pair])
    return F.coalesce(F.try_element_at(table, text), F.try_element_at(table, head))


class Words(dict):
    """The bytes of words by number; a word met for the first time is entered by `__missing__`."""

    def __init__(self) -> None:
        super().__init__()
        self.flat = bytearray()  # of all words, one after the other
        self.first, self.count = array("q"), array("q")

    def __missing__(self, word: str) -> int:
        """The word's letters, the first as a capital, which shows where words begin, the others small; a word
        without letters has no bytes, as signs and numbers have no language."""
        letters = word.lower()
        if not letters.isalpha():
            letters = "".join([c for c in letters if c.isalpha() or c in "'’"]).strip("'’")
        data = (letters[0].upper() + letters[1:]).encode("utf-8", "surrogatepass") if letters else b""
        self.first.append(len(self.flat))
        self.count.append(len(data))
        self.flat += data
        self[word] = n = len(self.first) - 1
        return n

    def sequences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all texts, the number of bytes of each word, and the number of words of each text."""
        number = self.__getitem__
        ids, lengths = [], []
        for t in texts:
            words = t.split()
            ids += map(number, words)
            lengths.append(len(words))
        word = np.array(ids, np.int64)
        counts = np.array(self.count, np.int64)[word] if len(word) else np.zeros(0, np.int64)
        starts = np.cumsum(counts) - counts
        at = np.repeat(np.array(self.first, np.int64)[word] - starts if len(word) else counts, counts) + np.arange(counts.sum())
        flat = np.frombuffer(bytes(self.flat), np.uint8)
        return flat[at] if len(at) else np.zeros(0, np.uint8), counts, np.array(lengths, np.int64)


class LanguageModel:
    def __init__(self, net: ByteGRU) -> None:
        self.net = net
        self.words = Words()

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> LanguageModel:
        net = ByteGRU(CLASSES, HIDDEN)
        net.p, net._ready = arrays, []
        return cls(net)

    def __getstate__(self) -> dict:
        return {"net": self.net, "words": Words()}

    def log_probabilities(self, texts: list[str]) -> list[np.ndarray]:
        """Log probabilities of the languages, and of any other, for each word of each text: every byte is
        labelled, and a word's logits are the mean of its bytes'."""
        logp, words = self._scores(texts)
        return np.split(logp, np.cumsum(words)[:-1]) if len(texts) else []

    def _scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of all words, one after the other, and the number of words of each text."""
        if len(self.words) > 300_000:
            self.words = Words()
        data, counts, words = self.words.sequences(texts)
        # a row a class in memory, as most work goes over all words class by class
        logp = np.full((CLASSES, len(counts)), -np.log(CLASSES), np.float32)  # words without letters favour none
        if len(data):
            sums = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(words)]
            y = self._pooled(data, np.diff(sums, prepend=0), counts[counts > 0])
            y -= y.max(axis=0)
            y -= np.log(np.exp(y).sum(axis=0))
            logp[:, counts > 0] = y
        return logp.T, words

    def _pooled(self, data: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Mean logits (classes × words) of each word. Texts are cut into segments that overlap by their context; each gives its middle."""
        per = np.maximum(1, -(-lengths // SEGMENT)) * (lengths > 0)
        owner = np.repeat(np.arange(len(lengths)), per)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        begin_of = np.cumsum(lengths) - lengths
        end = begin_of[owner] + lengths[owner]
        core = begin_of[owner] + nth * SEGMENT
        core_end = np.minimum(core + SEGMENT, end)
        begin, stop = np.maximum(core - CONTEXT, begin_of[owner]), np.minimum(core_end + CONTEXT, end)
        first = np.cumsum(counts) - counts
        if graphs.AVAILABLE:
            y = self._in_pieces(data, begin, stop, core, first)
        else:
            y = np.add.reduceat(self._middles(data, begin, stop, core, core_end), first, axis=1)
        y /= counts.astype(np.float32)
        return y

    def _in_pieces(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray, core: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Sums of logits of the words that begin at `first`. A word is a piece, or more where segments meet within it."""
        word = np.searchsorted(first, core, "right") - 1
        cut = first[word] != core
        word, cut = word[cut], core[cut]
        pieces = np.insert(first, word + 1, cut)
        lengths = np.diff(pieces, append=len(data))
        edges = np.searchsorted(pieces, core)
        owner = np.repeat(np.arange(len(core)), np.diff(edges, append=len(pieces)))
        sums = np.empty((CLASSES, len(pieces)), np.float32)
        runs = -(-len(begin) // RUN)
        many = -(-len(begin) // runs)  # runs of one size, as a small one has no choice of lanes
        for i in range(0, len(begin), many):
            own = slice(i, i + many)
            a, b = edges[i], edges[i + many] if i + many < len(edges) else len(pieces)
            low = max(0, int(begin[i]) - 2)  # the two bytes before belong to a segment's first
            high = int(stop[own].max())
            sums[:, a:b] = self.net.summed(data[low:high], begin[own] - low, (stop - begin)[own], pieces[a:b] - low, owner[a:b] - i, lengths[a:b])
        if not len(cut):
            return sums
        rest = word + 1 + np.arange(len(word))
        y = np.delete(sums, rest, axis=1)
        np.add.at(y.T, word, sums[:, rest].T)
        return y

    def _middles(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray, core: np.ndarray, core_end: np.ndarray) -> np.ndarray:
        """Logits (classes × bytes) of the segments' middles, without the graph."""
        out = np.empty((CLASSES, len(data)), np.float32)
        for i in range(0, len(begin), RUN):
            pick = i + np.argsort(begin[i : i + RUN] - stop[i : i + RUN], kind="stable")
            size = stop[pick] - begin[pick]
            low = max(0, int(begin[i]) - 2)  # the two bytes before belong to a segment's first
            y = np.ascontiguousarray(self.net.logits(data[low : int(stop[pick].max())], begin[pick] - low, size).T)
            first = np.cumsum(size) - size + core[pick] - begin[pick]
            for at, end_, source in zip(core[pick].tolist(), core_end[pick].tolist(), first.tolist()):
                out[:, at:end_] = y[:, source : source + end_ - at]
        return out


def paths(logp: list[np.ndarray]) -> list[np.ndarray]:
    """The likeliest language of every word of each text, where each change costs SWITCH.

    Most texts have one language beyond doubt, which is shown without a search (see `steady`); the others
    are searched all at once, longest first, word by word from both ends of the recursion.
    """
    words = np.array([len(x) for x in logp], np.int64)
    return np.split(_ways(np.concatenate(logp), words), np.cumsum(words)[:-1]) if logp else []


def _ways(flat: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The paths of all texts, one after the other."""
    best, sure = steady(flat, words)
    out = np.repeat(best, words).astype(np.int8)
    rest = np.flatnonzero(~sure)
    begin = np.cumsum(words) - words
    for i, path in zip(rest.tolist(), _searched([flat[begin[i] : begin[i] + words[i]] for i in rest])):
        out[begin[i] : begin[i] + len(path)] = path
    return out


def _searched(logp: list[np.ndarray]) -> list[np.ndarray]:
    """Scores of all texts' words stand class by class, the first words of all texts before the second ones; what a step
    must not decide by itself, where each language comes from, is found for all words at once."""
    order = sorted(range(len(logp)), key=lambda i: -len(logp[i]))
    lengths = np.array([len(logp[i]) for i in order], np.int64)
    longest = int(lengths[0]) if len(order) else 0
    out = [np.zeros(len(x), np.int8) for x in logp]
    if not longest:
        return out
    active = np.searchsorted(-lengths, -np.arange(longest), "left")  # texts longer than t
    ends = np.cumsum(active)
    nth = np.repeat(np.arange(len(order)), lengths)
    begin = np.cumsum(lengths) - lengths
    at = (ends - active)[np.arange(len(nth)) - begin[nth]] + nth
    score = np.empty((CLASSES, len(at)), np.float32)
    score[:, at] = np.concatenate([logp[i] for i in order]).T
    edges = [0, *ends.tolist()]
    for a, b, c in zip(edges, edges[1:], edges[2:]):
        before = score[:, a : a + c - b]
        score[:, b:c] += np.maximum(before, before.max(axis=0) - SWITCH)
    best = score.argmax(axis=0)
    source = np.where(score < score.max(axis=0) - SWITCH, best, np.arange(CLASSES)[:, None]).astype(np.int8)
    path = best.astype(np.int8)
    for a, b, c in zip(edges[-3::-1], edges[-2::-1], edges[:0:-1]):
        path[a : a + c - b] = source[path[b:c], np.arange(a, a + c - b)]
    for i, own in zip(order, np.split(path[at], begin[1:])):
        out[i] = own
    return out


def steady(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest single language of each text, and whether no path with a change can beat it.

    A detour gains at most the greatest sum of a stretch by which others lead, and costs a change at least.
    """
    begin = np.cumsum(lengths) - lengths
    some = lengths > 0
    best = np.zeros(len(lengths), np.int64)
    best[some] = np.add.reduceat(flat, begin[some], axis=0).argmax(axis=1)
    own = np.repeat(best, lengths)
    lead = flat.max(axis=1) - np.take_along_axis(flat, own[:, None], 1)[:, 0]
    # a language leads over itself by nothing: where the own one is the likeliest, the next behind it counts
    ahead = np.where(lead > 0, lead, _behind(flat, own))
    text = np.repeat(np.arange(len(lengths)), lengths)
    drop = float(np.abs(ahead).sum()) + 1.0  # each text begins lower than all before ended, so no stretch spans two
    run = np.cumsum(ahead, dtype=np.float64) - drop * text
    low = np.minimum.accumulate(np.concatenate([[0.0], run[:-1]]) - drop * np.diff(text, prepend=0).clip(0, 1))
    gain = np.zeros(len(lengths))
    gain[some] = np.maximum.reduceat(run - low, begin[some])
    return best, gain < SWITCH


def _behind(flat: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How far the best other language lies behind the own one, as a negative number."""
    out = np.full(len(own), -np.inf, np.float32)
    mine = np.take_along_axis(flat, own[:, None], 1)[:, 0]
    for c in range(CLASSES):
        np.maximum(out, np.where(own == c, -np.inf, flat[:, c] - mine), out=out)
    return out


def clear_words(logp: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Words whose likeliest language is the path's, and well ahead of every other."""
    own = np.take_along_axis(logp, path[:, None].astype(np.int64), 1)[:, 0]
    ahead = np.full(len(path), np.inf, np.float32)
    for c in range(CLASSES):
        np.minimum(ahead, np.where(path == c, np.inf, own - logp[:, c]), out=ahead)
    return ahead > CLEAR


def passages(logp: np.ndarray, path: np.ndarray, clear: np.ndarray | None = None) -> list[tuple[int, int, int, float]]:
    """(language, first word, end, confidence) of the runs of a path, cut to their clear words."""
    clear = clear_words(logp, path) if clear is None else clear
    _, *found = _runs(logp, path, np.array([len(path)]), clear)
    return list(zip(*(x.tolist() for x in found)))


def _runs(flat: np.ndarray, way: np.ndarray, words: np.ndarray, clear: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, language, first word, end and confidence of the passages of all texts."""
    begin = np.cumsum(words) - words
    new = np.diff(way, prepend=-1) != 0
    new[begin[words > 0]] = True
    at = np.flatnonzero(clear)
    first = np.flatnonzero(np.diff(np.cumsum(new)[at], prepend=0))  # of the clear words, each run's first
    last = np.append(first[1:], len(at))[: len(first)] - 1
    lang = way[at]
    sure = np.exp(flat[at, lang].astype(np.float64))
    confidence = np.add.reduceat(sure, first) / (last - first + 1) if len(at) else sure
    text = np.repeat(np.arange(len(words)), words)[at[first]]
    return text, lang[first], at[first] - begin[text], at[last] + 1 - begin[text], confidence


def _training_windows(texts: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of bytes (rows; 0 pads) and their texts' languages."""
    rows, langs = [], []
    words = Words()
    for lang, t in texts:
        data = words.sequences([t])[0]
        for i in range(0, len(data), TRAIN_WINDOW):
            part = data[i : i + TRAIN_WINDOW]
            if len(part) >= 40:
                rows.append(np.pad(part, (0, TRAIN_WINDOW - len(part))))
                langs.append(lang)
    return np.array(rows, np.uint8).reshape(-1, TRAIN_WINDOW), np.array(langs, np.int64)


#: First and last letters of scripts that none of the languages is written in.
_SCRIPTS = [(0x3B1, 0x3C9), (0x430, 0x44F), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x3042, 0x3093), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]


def _foreign(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Windows of no known language: words of other scripts, or the letters of windows put in another order."""
    out = []
    for row in rows:
        if rng.random() < 0.5:
            letters = np.frombuffer(row.tobytes().rstrip(b"\0").lower(), np.uint8)
            starts = (row[: len(letters)] >= 65) & (row[: len(letters)] <= 90)
            mixed = rng.permutation(letters)
            data = np.where(starts & (mixed >= 97) & (mixed <= 122), mixed - 32, mixed).astype(np.uint8).tobytes()
        else:
            a, b = _SCRIPTS[int(rng.integers(len(_SCRIPTS)))]
            codes = rng.integers(a, b + 1, TRAIN_WINDOW)
            data = "".join(chr(c).upper() if x else chr(c) for c, x in zip(codes, rng.random(TRAIN_WINDOW) < 0.15)).encode()
        out.append(np.frombuffer(data[:TRAIN_WINDOW].ljust(TRAIN_WINDOW, b"\0"), np.uint8))
    return np.array(out, np.uint8).reshape(-1, TRAIN_WINDOW)


def fit(texts: list[tuple[int, str]], batches: int = BATCHES, seed: int = 11) -> LanguageModel:
    """Train on (language, text) pairs. Labels may be wrong and texts mixed: after a third of the batches
    only those windows stay whose likeliest language by the network so far is their label."""
    model = LanguageModel(ByteGRU(CLASSES, HIDDEN, seed))
    net, rng = model.net, np.random.default_rng(seed)
    adam = Adam(net.p, RATE)
    rows, langs = _training_windows(texts)
    if not len(rows):
        return model
    order = np.zeros(0, np.int64)
    for step in range(batches):
        if step == batches // 3:
            agree = _guesses(net, rows) == langs
            if agree.any():
                rows, langs, order = rows[agree], langs[agree], order[:0]
        if not step or step == batches // 3:
            share = np.bincount(langs, minlength=CLASSES) / len(langs)
            balance = np.where(share > 0, 1 / np.maximum(share * len(LANGUAGES), 1e-3), 1).astype(np.float32)
        while len(order) < BATCH:
            order = np.concatenate([order, rng.permutation(len(rows))])
        pick, order = order[:BATCH], order[BATCH:]
        adam.rate = RATE * (1 - 0.9 * step / batches)
        ids, own = rows[pick].T.copy(), np.repeat(langs[pick][None], TRAIN_WINDOW, axis=0)
        other = np.flatnonzero(rng.random(BATCH) < OTHER_SHARE)
        ids[:, other], own[:, other] = _foreign(ids[:, other].T, rng).T, CLASSES - 1
        ids, own = _spliced(ids, own, rng)
        _, grads = net.gradients(ids, own, ((ids > 0) * balance[own]).astype(np.float32))
        adam.step(grads)
    return model


def _guesses(net: ByteGRU, rows: np.ndarray) -> np.ndarray:
    """The likeliest language of each window as a whole."""
    out = []
    for i in range(0, len(rows), 1024):
        part = rows[i : i + 1024]
        n = len(part)
        y = net.logits(part.ravel(), np.arange(n) * TRAIN_WINDOW, np.full(n, TRAIN_WINDOW)).reshape(n, TRAIN_WINDOW, CLASSES)
        y -= y.max(axis=2, keepdims=True)
        y -= np.log(np.exp(y).sum(axis=2, keepdims=True))
        out.append((y * (part > 0)[..., None]).sum(axis=1).argmax(axis=1))
    return np.concatenate(out)


def _spliced(ids: np.ndarray, own: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Half the windows with a stretch of another one put in, so that the network learns where languages change."""
    ids, own = ids.copy(), own.copy()
    partner = rng.permutation(ids.shape[1])
    for k in np.flatnonzero(rng.random(ids.shape[1]) < 0.5):
        starts = np.flatnonzero((ids[:, partner[k]] >= 65) & (ids[:, partner[k]] <= 90))  # whole words of the other
        if len(starts) > 2:
            a, b = sorted(rng.choice(starts, 2, replace=False))
            ids[a:b, k], own[a:b, k] = ids[a:b, partner[k]], own[a:b, partner[k]]
    return ids, own


def train(df: DataFrame, key: str, text: str, label: str, texts: int = TRAIN_TEXTS) -> LanguageModel:
    """Fit on at most about `texts` labelled texts of each language, drawn by a hash of the key."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), known_language(F.col(label)).alias("l")).where("l is not null").where(F.length("t").between(1, TRAIN_CHARS))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}  # one row a language
    scale = 1 << 20
    share = F.lit(0)
    for code, n in counts.items():
        share = F.when(F.col("l") == code, min(scale, -(-scale * texts // n))).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64("k"), F.lit(scale)) < share).select("l", "t").limit(3 * texts * len(LANGUAGES))
    sample = sorted((LANGUAGES.index(lang), t) for lang, t in drawn.collect())
    return LanguageModel.of(trained(df.sparkSession, "language", digest(sample, ("language", "gru", "graphs")), lambda: fit(sample).net.p))


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First rows and numbers of rows of groups of texts of about GROUP_BYTES; a longer text is a group of its own."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > GROUP_BYTES:
            yield start, i - start
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes) - start


_SCHEMA = "lang string, first_word int, words int, confidence double, doc_lang string, doc_confidence double, mixed boolean"


def language_passages(df: DataFrame, key: str, text: str, label: str, model: LanguageModel | None = None) -> DataFrame:
    """Every passage of each text, in order: (`key`, `label`, `known`: the language the label names,
    `lang`, `first_word`, `words`, `confidence`, `doc_lang`, `doc_confidence`, `mixed`).

    `doc_lang` is pooled from all words; `mixed` tells whether languages other than one have a passage
    of MIN_WORDS words. Null, empty and blank texts, and texts without a clear word, have no passage;
    repeated rows repeat; null keys stay null; no rows give no rows; texts are read whole. Rows are
    independent: nothing is shuffled. Other columns are not read.
    """
    model = model or train(df, key, text, label)
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(label).alias("label"), known_language(F.col(label)).alias("known"), F.col(text).alias("t")).where(F.length("t") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for at, n in _groups(batch.column(3)):
                part = batch.slice(at, n)
                texts = part.column(3).dictionary_encode()  # equal texts are labelled once
                text_of = texts.indices.to_numpy()
                flat, words = own._scores(texts.dictionary.to_pylist())
                if not len(flat):
                    continue
                way = _ways(flat, words)
                text, lang, first, end, confidence = _runs(flat, way, words, clear_words(flat, way))
                some = words > 0
                mean = np.zeros((len(words), CLASSES))
                mean[some] = np.add.reduceat(flat, (np.cumsum(words) - words)[some], axis=0) / words[some][:, None]
                pooled = np.exp(mean - mean.max(axis=1, keepdims=True))
                pooled /= pooled.sum(axis=1, keepdims=True)
                long = (end - first >= MIN_WORDS) & (lang < len(LANGUAGES))
                mixed = np.bincount(np.unique(text[long] * CLASSES + lang[long]) // CLASSES, minlength=len(words)) > 1
                # a row of each passage for each row of its text
                by_text = np.argsort(text_of, kind="stable")
                count = np.bincount(text, minlength=len(words))
                each = count[text_of[by_text]]
                where = np.repeat(by_text, each)
                row = np.arange(len(where)) - np.repeat(np.cumsum(each) - each - (np.cumsum(count) - count)[text_of[by_text]], each)
                if len(where):
                    names = ["k", "label", "known", *(x.split()[0] for x in _SCHEMA.split(", "))]
                    doc, named = text[row], lambda x: pa.array(NAMES).take(pa.array(x))
                    columns = [part.column(c).take(pa.array(where)) for c in range(3)]
                    columns += [named(lang[row]), pa.array(first[row], pa.int32()), pa.array((end - first)[row], pa.int32()), pa.array(confidence[row])]
                    yield pa.RecordBatch.from_arrays([*columns, named(pooled.argmax(axis=1)[doc]), pa.array(pooled.max(axis=1)[doc]), pa.array(mixed[doc])], names)

    return rows.mapInArrow(run, f"k {kind}, label string, known string, {_SCHEMA}").withColumnRenamed("k", key)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_passages(load(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    wrong = F.col("known").isNull() | (F.col("known") != F.col("lang")) | F.col("mixed")
    return found.where((F.col("words") >= MIN_WORDS) & F.col("lang").isin(LANGUAGES)).where(wrong).select("doc_id", "lang").distinct()


def p10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage with its confidence and its document's language."""
    return language_passages(load(spark, sf_dir, "documents"), "doc_id", "text", "lang")
