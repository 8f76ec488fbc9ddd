import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import graphs, language
from lodestar.llm.gru import ByteGRU
from lodestar.llm.language import LANGUAGES, NAMES, SEGMENT, fit, known_language, language_passages, passages, paths

SENTENCES = {
    "en": "the team kept a record of every mistake and followed the rules which were written before it started with care",
    "fr": "les équipes ont suivi chaque dossier avec une grande attention pour que les données soient justes dans le temps",
    "de": "die Abteilung prüfte jeden Bericht mit großer Sorgfalt und schulte viele Anfänger für die neue Aufgabe darin",
    "es": "el equipo siguió cada informe con mucha atención para que los datos fueran correctos durante todo el año pasado",
    "pt": "a equipa seguiu cada relatório com muita atenção para que os dados fossem corretos durante todo o ano passado",
    "it": "la squadra ha seguito ogni relazione con molta attenzione perché i dati fossero corretti durante tutto l'anno scorso",
}


def sentence(lang, rng):
    words = SENTENCES[lang].split()
    rng.shuffle(words)
    return " ".join(words)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(3)
    return fit([(LANGUAGES.index(k), ". ".join(sentence(k, rng) for _ in range(4))) for k in LANGUAGES for _ in range(40)])


def test_gradients():
    net, rng = ByteGRU(3, hidden=4), np.random.default_rng(0)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    data, target, weight = rng.integers(97, 105, (7, 2)).astype(np.uint8), rng.integers(0, 3, (7, 2)), np.ones((7, 2))
    _, g = net.gradients(data, target, weight)
    for k in ("U", "T", "V", "vb", "c"):
        values = g[k]
        if isinstance(values, tuple):
            rows, sums = values
            at, got = (int(rows[1]), 2), sums[1][2]
        else:
            at = tuple(int(x[0]) for x in np.nonzero(values))
            got = values[at]
        old, out = net.p[k][at], []
        for d in (1e-3, -1e-3):
            net.p[k][at] = old + d
            out.append(net.gradients(data, target, weight)[0])
        net.p[k][at] = old
        assert abs((out[0] - out[1]) / 2e-3 - got) < 2e-3, k


def test_logits_of_many_sequences_are_those_of_each():
    net, rng = ByteGRU(3, hidden=4), np.random.default_rng(5)
    data = rng.integers(97, 123, 200).astype(np.uint8)
    begin, size = np.array([10, 100, 60, 180]), np.array([50, 40, 30, 1])
    at = np.cumsum(size) - size
    many = net.logits(data, begin, size)
    for a, b, n in zip(at, begin, size):
        assert np.allclose(many[a : a + n], net.logits(data, np.array([b]), np.array([n])), atol=1e-6)


def test_long_texts_by_segments_are_as_in_one_go(model):
    rng = random.Random(6)
    text = ". ".join(sentence("es", rng) for _ in range(40))
    (lp,) = model.log_probabilities([text])
    data, counts, _ = model.words.sequences([text])
    logits = model.net.logits(data, np.array([0]), np.array([len(data)]))
    own = counts[counts > 0]
    whole = (np.add.reduceat(logits, np.cumsum(own) - own, axis=0) / own[:, None]).argmax(axis=1)
    assert (lp.argmax(axis=1) == whole).mean() > 0.99 and len(data) > SEGMENT * 3


def test_other_scripts_are_no_known_language(model):
    (lp,) = model.log_probabilities(["рынок облигаций вырос на прошлой неделе несмотря на решение банка " * 4])
    assert NAMES[int(lp.sum(axis=0).argmax())] == "other"


def test_held_out_accuracy(model):
    rng = random.Random(9)
    texts = [(k, ". ".join(sentence(k, rng) for _ in range(3))) for k in LANGUAGES for _ in range(20)]
    logp = model.log_probabilities([t for _, t in texts])
    right = sum(LANGUAGES[int(p.sum(axis=0).argmax())] == k for (k, _), p in zip(texts, logp))
    assert right >= 0.98 * len(texts)


def test_mixed_text_gives_its_passages(model):
    rng = random.Random(1)
    a, b = (". ".join(sentence(k, rng) for _ in range(3)) for k in ("en", "de"))
    (lp,) = model.log_probabilities([f"{a}. 2019 • {b}"])
    found = passages(lp, paths([lp])[0])
    assert [LANGUAGES[f[0]] for f in found] == ["en", "de"]
    assert all(abs((f[2] - f[1]) - 3 * len(SENTENCES[k].split())) <= 4 for f, k in zip(found, ("en", "de")))


def test_paths_same_as_one_by_one():
    rng = np.random.default_rng(2)
    logp = [np.log(rng.dirichlet(np.ones(7), n)).astype(np.float32) for n in (0, 1, 7, 30, 3)]
    for many, x in zip(paths(logp), logp):
        assert (paths([x])[0] == many).all()


def test_texts_of_one_language_need_no_search():
    """What is shown without a search is what the search gives; both kinds of text occur."""
    rng = np.random.default_rng(8)
    logp = []
    for n in (1, 5, 40, 200, 0, 90, 300, 60):
        for sharp in (0.05, 0.5, 3.0):
            lead = np.eye(7)[rng.integers(0, 7)] * 20 * (rng.random() < 0.7)
            x = rng.dirichlet(np.full(7, sharp) + lead, n) if n else np.zeros((0, 7))
            if n > 50 and rng.random() < 0.5:
                x[n // 2 :] = np.roll(x[n // 2 :], 2, axis=1)
            logp.append(np.log(x + 1e-6).astype(np.float32))
    best, sure = language.steady(np.concatenate(logp), np.array([len(x) for x in logp]))
    searched = language._searched(logp)
    assert sure.any() and not sure.all()
    for x, b, s, path in zip(logp, best, sure, searched):
        assert not s or (path == b).all()


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ["EN", "en-GB", "Deutsch", "fr_CH", " por ", "ca", "und", "??", "", None, "English"]], "l string")
    assert [r[0] for r in df.select(known_language(F.col("l"))).collect()] == ["en", "en", "de", "fr", "pt", None, None, None, None, None, "en"]


def test_table(spark, model):
    rng = random.Random(4)
    long = ". ".join(sentence("fr", rng) for _ in range(300))
    rows = [(1, "en", long, 1), (1, "en", long, 1), (2, "en", None, 1), (3, None, "", 1), (4, "en", " \n", 1), (5, "en", "12 34 — •", 1), (None, None, long, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string, words int")
    got = language_passages(df, "doc_id", "text", "lang", model).collect()
    assert {(r.doc_id, r.lang, r.known) for r in got} == {(1, "fr", "en"), (None, "fr", None)} or {r.doc_id for r in got} == {1, None}
    assert all(0 < r.confidence <= 1 for r in got)
    assert language_passages(df.limit(0), "doc_id", "text", "lang", model).count() == 0


def test_graph_gives_what_numpy_gives_in_less_time(monkeypatch):
    """Segments of all lengths; the time, of the processor, is what the check's budget was exceeded by."""
    net, rng = ByteGRU(7, hidden=16), np.random.default_rng(7)
    data = np.frombuffer("".join(sentence(k, random.Random(i)).title().replace(" ", "") for i in range(40) for k in LANGUAGES).encode(), np.uint8)[:20_000]
    size = np.sort(np.concatenate([np.full(1000, 528), rng.integers(1, 528, 300)]))[::-1]
    begin = rng.integers(0, 19_000, len(size))
    got, took = {}, {}
    for there in (True, False):
        monkeypatch.setattr(graphs, "AVAILABLE", there)
        net._ready = []
        net.logits(data, begin[:1], size[:1])
        spent = []
        for _ in range(3):
            start = time.thread_time()
            got[there] = net.logits(data, begin, size)
            spent.append(time.thread_time() - start)
        took[there] = min(spent)
    assert np.allclose(got[True], got[False], atol=1e-5)
    assert took[True] < 0.85 * took[False], took


def test_segments_read_in_parts_are_as_in_one(model, monkeypatch):
    rng = random.Random(12)
    texts = [". ".join(sentence(k, rng) for _ in range(n)) for k, n in zip(LANGUAGES, (1, 9, 0, 30, 4, 17))]
    whole = model.log_probabilities(texts)
    monkeypatch.setattr(language, "RUN", 3)
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(whole, model.log_probabilities(texts)))


def test_words_have_the_same_logits_with_and_without_the_graph(model, monkeypatch):
    rng = random.Random(13)
    texts = [". ".join(sentence(k, rng) for _ in range(n)) for k, n in zip(LANGUAGES, (2, 11, 0, 25, 1, 6))] + ["", "12 — 34"]
    got = {}
    for there in (True, False):
        monkeypatch.setattr(graphs, "AVAILABLE", there)
        model.net._ready = []
        got[there] = model.log_probabilities(texts)
    model.net._ready = []
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(got[True], got[False]))


def test_letters_of_words():
    words = language.Words()
    for word, wanted in (("Grüße,", "Grüße"), ("don’t", "Don’t"), ("'tis'", "Tis"), ("2019", ""), ("İzmir", "Izmir"), ("C3PO", "Cpo"), ("É", "É"), ("—", "")):
        assert words.sequences([word])[0].tobytes().decode() == wanted, word


def test_graph_takes_few_steps_of_many_lanes(model):
    """Texts of all lengths. A step costs as much as about a hundred lanes besides, so narrow steps of short segments,
    and what fills them up, took a good part of the check's budget."""
    rng = random.Random(14)
    texts = [" ".join(sentence(rng.choice(LANGUAGES), rng) for _ in range(rng.randint(1, 40))) for _ in range(600)]
    model.net._ready = []
    graph, fed = model.net._graph(), []
    run = graph.session.run
    graph.session = type("Counted", (), {"run": lambda self, names, given: fed.append(next(x.shape for x in given.values() if x.dtype == np.int32)) or run(names, given)})()
    model.log_probabilities(texts)
    model.net._ready = []
    data, counts, words = language.Words().sequences(texts)
    lengths = [int(x.sum()) for x in np.split(counts, np.cumsum(words)[:-1])]
    context = sum(2 * language.CONTEXT * ((n - 1) // SEGMENT) for n in lengths)
    assert len(data) + context <= sum(t * n for t, n in fed)
    assert sum(t * (n + 100) for t, n in fed) < 1.25 * (len(data) + context)


def test_dealt_sequences_share_no_place():
    rng = np.random.default_rng(15)
    for size in (np.array([1]), np.array([7, 7, 7]), np.array([1, 900]), rng.integers(1, 529, 3000), np.full(2048, 528)):
        lane, start, lanes, length = graphs.dealt(size)
        taken = np.zeros((lanes, length), np.int64)
        for a, b, n in zip(lane, start, size):
            taken[a, b : b + n + 1] += 1  # with the place that belongs to none
            assert b + n < length
        assert taken.max() == 1 and taken.sum() == (size + 1).sum()


def test_paths_are_the_best_of_all():
    """Against every path, and against the recursion word by word in floating point."""
    rng = np.random.default_rng(16)
    logp = [np.log(rng.dirichlet(np.full(7, 0.05), n) + 1e-9).astype(np.float32) for n in (1, 2, 60, 4, 250, 3, 90)]
    value = lambda x, path: sum(float(x[t, c]) for t, c in enumerate(path)) - language.SWITCH * sum(a != b for a, b in zip(path, path[1:]))
    for x, found in zip(logp, language._searched(logp)):
        if len(x) < 5:
            assert value(x, found) >= max(value(x, p) for p in itertools.product(range(7), repeat=len(x))) - 1e-4
        s = x[0].astype(np.float64)
        for row in x[1:]:
            s = np.maximum(s, s.max() - language.SWITCH) + row
        assert abs(value(x, found) - s.max()) < 1e-2


def test_passages_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(17)
    logp = [np.log(rng.dirichlet(np.full(7, 0.1), n) + 1e-9).astype(np.float32) for n in (0, 1, 30, 0, 200, 5)] + [np.full((9, 7), -np.log(7), np.float32)]
    words = np.array([len(x) for x in logp])
    way = paths(logp)
    flat, whole = np.concatenate(logp), np.concatenate(way)
    found = list(zip(*(x.tolist() for x in language._runs(flat, whole, words, language.clear_words(flat, whole)))))
    assert found == [(i, *p) for i, (x, w) in enumerate(zip(logp, way)) for p in passages(x, w)]
    for _, lang, a, b, confidence in found:
        assert a < b and 0 < confidence <= 1
    assert not passages(logp[-1], way[-1])
