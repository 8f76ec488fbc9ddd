import itertools
import pickle
import random
import time

import numpy as np
import pytest

from lodestar.llm import graphs
from lodestar.llm.lstm_crf import LstmCrf
from lodestar.llm.models import digest, read, save, trained
from lodestar.llm.pii import Encoded, Tagger, find_pii, fit, redact, redact_texts, tidied
from lodestar.llm.pii_labels import TYPES, NameForms, form_spans

GIVEN = "Ada Bruno Clara Dario Edda Falk Greta Hugo Ilka Jonas Karin Lorenz".split()
FAMILY = "Brinkmoor Castellay Dornwick Esterhal Fenwyck Galbrand Harrowin Isenford".split()
NAMES = [f"{g} {f}" for g in GIVEN for f in FAMILY]
SENTENCES = [
    "Reported to {} throughout.", "Call {p} or mail {e} soon.", "Lives at {a}, so no relocation.", "Right-to-work seen, DNI {i}.", "{}, Senior Analyst, {p}",
    "Built the Coppergate Pinnace model for 415 issuers in total.", "Senior Analyst — Yewdale Pinnace Consulting, Zürich (2019-10 – 2020-02)", "Now at Brinkmoor & Dornwick Bank.",
    "Working paper no. 7474.1729", "ISSN 6423-3610", "Invoice 9689898572", "Follow up once the rates head is back.",
]


def made(n, seed):
    """Texts with the spans that are in them."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        text, spans = "", []
        for s in rng.sample(SENTENCES, 5):
            for part in __import__("re").split(r"(\{\w?\})", s):
                kind = {"{}": "name", "{p}": "phone", "{e}": "email", "{a}": "address", "{i}": "id"}.get(part)
                if kind:
                    part = {
                        "name": rng.choice(NAMES), "phone": f"+44 7700 900{rng.randrange(100, 999)}", "email": f"x{rng.randrange(99)}@mail.example",
                        "address": f"{rng.randrange(1, 300)} Otter Road", "id": f"{rng.randrange(10**7, 10**8)}K",
                    }[kind]
                    spans.append((kind, part))
                text += part
            text += "\n"
        out.append((text, spans))
    return out


@pytest.fixture(scope="module")
def tagger():
    return fit([t for t, _ in made(500, 1)], NAMES, epochs=5)


def test_gradients_and_viterbi():
    net, rng = LstmCrf(3, 7, 5, hidden=3), np.random.default_rng(0)
    for k in net.p:
        net.p[k] = rng.normal(size=net.p[k].shape)
    chars, words, tags = rng.integers(0, 7, (5, 2)), rng.integers(0, 5, (5, 2)), rng.integers(0, 3, (5, 2))
    _, g = net.gradients(chars, words, tags)
    for k in ("Uf", "Cb", "Wf", "bb", "V", "vb", "A"):
        at = tuple(rng.integers(0, s) for s in net.p[k].shape)
        old, out = net.p[k][at], []
        for d in (1e-3, -1e-3):
            net.p[k][at] = old + d
            out.append(net.gradients(chars, words, tags)[0])
        net.p[k][at] = old
        if isinstance(g[k], tuple):
            rows, values = g[k]
            got = values[list(rows).index(at[0])][at[1]] if at[0] in rows else 0.0
        else:
            got = g[k][at]
        assert abs((out[0] - out[1]) / 2e-3 - got) < 5e-3, k
    begin, size = np.array([0, 5]), np.array([5, 5])
    e, a = net.emissions(chars.T.ravel(), words.T.ravel(), begin, size).reshape(2, 5, 3).transpose(1, 0, 2), net.p["A"]
    for b in range(2):
        score = lambda p: sum(e[t, b, x] for t, x in enumerate(p)) + sum(a[x, y] for x, y in zip([0, *p], [*p, 0]))
        assert abs(score(net.path(e[:, b])) - max(map(score, itertools.product(range(3), repeat=5)))) < 1e-4


def test_path_of_a_long_sequence_is_the_best_of_all():
    """Falls into stretches at sure zeros; compared with a plain Viterbi over the whole."""
    net, rng = LstmCrf(4, 7, 5, hidden=3), np.random.default_rng(4)
    net.p["A"] = rng.normal(size=(4, 4)).astype(np.float32)
    e = rng.normal(size=(3000, 4)).astype(np.float32) * 2
    e[rng.random(3000) < 0.2, 0] += 30
    best, back = e[0].astype(float) + net.p["A"][0], []
    for t in range(1, len(e)):
        s = best[:, None] + net.p["A"]
        back.append(s.argmax(axis=0))
        best = s.max(axis=0) + e[t]
    path = [int((best + net.p["A"][:, 0]).argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    assert net.path(e).tolist() == path[::-1]
    assert net.path(e[:0]).tolist() == []


def test_held_out_accuracy(tagger):
    found = right = true = 0
    data = made(200, 2)
    for (text, gold), spans in zip(data, tagger.spans([t for t, _ in data])):
        got = {(k, text[a:b]) for a, b, k in spans}
        found, right, true = found + len(got), right + len(got & set(gold)), true + len(set(gold))
    assert right / true > 0.96 and right / found > 0.96, (right, found, true)


def test_written_forms():
    cases = {
        "email": ["a.b+cv@mx.site.example", "ann (at) post (dot) example (dot) net", "i4[at]mailbox.example", "z.i @ mx.example"],
        "phone": ["+49 (0)30 23125 679", "0044-7700-900554", "+1 (254) 555-0161", "364.555.0145", "020 7946 0965", "+447700900632", "+33 1 99 00 10 24"],
        "address": ["C/ Almendro 138, 1º A", "Flat 4, 49 Gannet Rd", "132 Otter Road", "Rua da Ferradura, 230", "Bramblestraße 182", "68 bis rue des Tanneurs", "Via del Mulino 191", "7 rue de la Forge", "C/ Almendro 138, 1Âº A", "BramblestraÃŸe 182", "Bramblestra√üe 4b"],
    }
    for kind, texts in cases.items():
        for t in texts:
            s = f"Tel. {t} | x"
            assert [(s[a:b], k) for a, b, k in form_spans(s)] == [(t, kind)], t
    for caption, number in (("SSN", "912-00-3929"), ("National Insurance", "QQ 53 76 93 B"), ("Passport No", "ZZ7630901"), ("NIF", "32 980 462 435"), ("DNI", "63900623G")):
        assert [(f"{caption} {number}."[a:b], k) for a, b, k in form_spans(f"{caption} {number}.")] == [(number, "id")]
    for t in ("Req. ref 3666-8424-58", "ISSN 6423-3610", "pp. 71-3898", "Book value 42 2577 000", "Build 88.88.88.88", "ISBN 978-0-9467-5099-0", "Desk code 9518/7102", "list v18 @ close 5804", "2019-10 – 2020-02"):
        assert form_spans(t) == [], t


def test_names_as_written():
    n = NameForms(NAMES)
    for t in ("Ada Brinkmoor", "ADA T. BRINKMOOR", "Brinkmoor, Ada", "A. Brinkmoor", "Ada-Hugo Brinkmoor", "Ada Brinkmoor Dornwick"):
        assert [f"x {t} y"[a:b] for a, b, _ in n.spans(f"x {t} y")] == [t], t
    assert n.spans("Brinkmoor & Dornwick Bank") == [] == n.spans("A. Brinkmoor and Dornwick Bank")
    assert len(n.spans("referred by Ada Brinkmoor and follows banks")) == 1


def test_redaction():
    assert redact("Call Ada Lo, +44 1 now", [(5, 11, "name"), (13, 18, "phone")]) == "Call [NAME], [PHONE] now"


def test_tables(spark, tagger):
    (text, gold), *_ = made(1, 5)
    long = "plain words here. " * 30000 + "Reported to Ada Brinkmoor throughout."
    rows = [(1, text, "k"), (1, text, "k"), (2, None, "k"), (3, "", "k"), (None, text, "k"), (4, long, "k"), (5, "\n\n", "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, pii_text string")
    got = find_pii(df, "doc_id", "text", tagger).collect()
    assert {r.doc_id for r in got} == {1, None, 4} and {r.pii_type for r in got} <= set(TYPES)
    assert all(r.pii_text == (long if r.doc_id == 4 else text)[r.char_start : r.char_end] for r in got)
    red = {(r.doc_id, r.redacted) for r in redact_texts(df, "doc_id", "text", tagger).collect()}
    assert (2, None) in red and (3, "") in red and any(i == 4 and x.endswith("Reported to [NAME] throughout.") for i, x in red)
    assert find_pii(df.limit(0), "doc_id", "text", tagger).count() == 0


def test_names_garbled_in_their_first_word():
    """The letters of a garbled word are parted, so no two capitalised words stand side by side."""
    given = "Brígida Zélie Thérèse Söhnke Núria Hélène Márta Jürgen".split()
    names = [f"{g} {f}" for g in given for f in FAMILY]
    rng = random.Random(3)
    lines = lambda name: f"the desk reads all notes each week and files them with the others at the end, reported to {name} throughout, and the rates team then goes on as before."
    tagger = fit(["\n".join(lines(rng.choice(names)) for _ in range(3)) + "\nno person is named in this line of the note" for _ in range(400)], names)
    wanted = [f"{g} {f}".encode().decode("cp1252", "replace") for g in given for f in FAMILY[:4]]
    texts = [lines(n) for n in wanted]
    got = [{t[a:b] for a, b, k in spans if k == "name"} for t, spans in zip(texts, tagger.spans(texts))]
    assert sum(n in g for n, g in zip(wanted, got)) >= 0.9 * len(wanted), [n for n, g in zip(wanted, got) if n not in g]


def test_windows_blend_to_one_everywhere(tagger, monkeypatch):
    net = Tagger(LstmCrf(2, 256, 8, hidden=2))
    monkeypatch.setattr(net.net, "emissions", lambda chars, words, begin, size: np.ones((int(size.sum()), 2), np.float32))
    for n in (0, 1, 383, 384, 385, 736, 737, 3000):
        enc = Encoded(["x" * n, "", "y" * n])
        total = net.emissions(enc)
        for b, m in zip(enc.begin, enc.length):
            assert np.allclose(total[b : b + m], 1), n


def test_a_text_gives_the_same_beside_any_other(tagger):
    texts = [t for t, _ in made(20, 8)]
    assert tagger.spans(texts) == [tagger.spans([t])[0] for t in texts]


def test_ends_come_from_the_network_alone():
    """Spans that no pattern knows stay; only marks, cut words and what cannot be of the type go."""
    for text, part, kind in (
        ("Lives Am Markt 5.", "Am Markt 5", "address"), ("at 12 Baker Boulevard now", "12 Baker Boulevard", "address"), ("Driving licence D1234567", "D1234567", "id"),
        ("no. 4471234", "4471234", "id"), ("write jane at example dot com!", "jane at example dot com", "email"), ("12 Gannet Rd. then", "12 Gannet Rd.", "address"), ("(0)30 23125 240", "(0)30 23125 240", "phone"),
    ):
        a = text.index(part)
        assert tidied(text, [(a, a + len(part), kind)]) == [(a, a + len(part), kind)], part
    assert tidied("Call 0123456 now", [(5, 8, "phone")]) == [(5, 12, "phone")]  # a number cut in two
    assert tidied("Call 0123 now", [(5, 9, "phone")]) == []  # four digits
    assert tidied("seen (ann (at) post.example) today", [(6, 10, "email"), (11, 27, "email")]) == [(6, 27, "email")]
    text = "Ada Brinkmoor ada@post.example"
    assert tidied(text, [(0, 3, "name"), (4, len(text), "email")]) == [(0, 13, "name"), (14, len(text), "email")]
    assert tidied("a maulowe b", [(2, 9, "email")]) == []  # nothing that stands for the sign


def test_networks_are_kept(spark, tagger, tmp_path):
    key = digest(["a", str(np.random.default_rng().random())], ("pii", "gru"), 1)
    calls = []
    train = lambda: calls.append(1) or tagger.net.p
    trained(spark, "pii", key, train), trained(spark, "pii", key, train)
    assert len(calls) == 2  # no folder is named
    spark.conf.set("spark.lodestar.models.dir", str(tmp_path))
    try:
        first, second = trained(spark, "pii", key, train), trained(spark, "pii", key, train)
    finally:
        spark.conf.unset("spark.lodestar.models.dir")
    assert len(calls) == 3 and all((first[k] == second[k]).all() for k in first)
    path = f"{tmp_path}/test-{key}.npz"
    save(spark, path, tagger.net.p)
    again = read(spark, path)
    assert read(spark, path + "x") is None and all((again[k] == v).all() for k, v in tagger.net.p.items())
    text = made(1, 3)[0][0]
    assert Tagger.of(again).spans([text]) == tagger.spans([text])


def test_emissions_are_those_of_the_states():
    net, rng = LstmCrf(3, 7, 5, hidden=3), np.random.default_rng(1)
    chars, words = rng.integers(0, 7, 40), rng.integers(0, 5, 40)
    begin, size = np.array([3, 20, 30]), np.array([9, 7, 1])
    got = np.split(net.emissions(chars, words, begin, size), np.cumsum(size)[:-1])
    for e, b, n in zip(got, begin, size):
        both = np.concatenate([net._run(d, chars[b : b + n, None], words[b : b + n, None])[:, 0] for d in "fb"], axis=1)
        assert np.allclose(both @ net.p["V"] + net.p["vb"], e, atol=1e-5)


def test_graph_gives_what_numpy_gives_in_less_time(monkeypatch):
    """Windows of all lengths; the time, of the processor, is what the check's budget was exceeded by."""
    net, rng = LstmCrf(6, 256, 1 << 14, hidden=20), np.random.default_rng(7)
    size = np.sort(np.concatenate([np.full(600, 384), rng.integers(1, 384, 300)]))[::-1]
    begin = rng.integers(0, 5000, len(size))
    chars, words = rng.integers(0, 256, 6000).astype(np.uint8), rng.integers(0, 1 << 14, 6000).astype(np.int32)
    got, took = {}, {}
    for there in (True, False):
        monkeypatch.setattr(graphs, "AVAILABLE", there)
        net.emissions(chars, words, begin[:1], size[:1])
        spent = []
        for _ in range(3):
            start = time.thread_time()
            got[there] = net.emissions(chars, words, begin, size)
            spent.append(time.thread_time() - start)
        took[there] = min(spent)
    assert np.allclose(got[True], got[False], atol=1e-5)
    assert took[True] < 0.65 * took[False], took


def test_graph_follows_training():
    """A network that was run, trained on and run again is run as it is then; it can be sent after it was run."""
    net, rng = LstmCrf(3, 7, 5, hidden=3), np.random.default_rng(2)
    chars, words = rng.integers(0, 7, (6, 2)), rng.integers(0, 5, (6, 2))
    run = lambda n: n.emissions(chars.T.ravel(), words.T.ravel(), np.array([0, 6]), np.array([6, 6]))
    before = run(net)
    net.gradients(chars, words, rng.integers(0, 3, (6, 2)))
    net.p["Uf"] += 0.5
    after = run(net)
    assert not np.allclose(before, after) and np.array_equal(run(pickle.loads(pickle.dumps(net))), after)
