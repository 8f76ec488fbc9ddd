import random
from collections import Counter

import pytest

from lodestar.llm.mojibake import CHAINS, Chain, Classifier, find_garbled, wide_words

SENTENCES = [
    "Après plusieurs années, l’équipe a présenté un résumé détaillé – très apprécié à Genève.",
    "Über zwölf Monate prüfte ich in Zürich die Märkte für Versicherungen • täglich.",
    "La gestión de energía en España enseñó más a los compañeros — según el informe.",
    "A avaliação de opções não terminou; São Paulo pediu relatórios às terças.",
    "Il desk’s résumé café naïve coöperate • São Tomé – Kraków — Málaga.",
]


def sample(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.sample(" ".join(SENTENCES).split(), 25)) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    words = Counter()
    for t in sample(300, 1):
        words.update(wide_words(t))
    return Classifier(words, [Chain(*c) for c in CHAINS])


def test_chains_round_trip():
    for c in map(lambda x: Chain(*x), CHAINS):
        if c.source == "utf-8":
            for s in SENTENCES:
                assert c.restore(c.garble("".join(x for x in s if not x.isascii()))) is not None


def test_held_out_accuracy(model):
    clean = sample(300, 2)
    assert sum(model.find(t) is not None for t in clean) <= 1
    for name in ("utf-8>cp1252", "utf-8>latin-1", "utf-8>cp1252x2", "utf-8>mac_roman", "utf-8>cp437", "utf-8>cp1251", "mac_roman>cp1252", "cp1252>cp1251"):
        chain = next(c for c in model.chains if c.name == name)
        right = restored = 0
        for t in clean:
            bad = chain.garble(t)
            right += model.find(bad) is not None
            restored += model.repair(bad)[0] == t
        assert right >= 0.99 * len(clean), name
        assert restored >= 0.9 * len(clean), (name, restored)


def test_signs_written_as_meant_are_no_case(model):
    for t in ("Ð, Þ, ß", "√2 ≈ 1,414 ± ½", "Γειά σου", "рынок облигаций", "├── models\n└── src", "İzmir, Łódź, Žilina", "东京 / 香港", "5′ 10″ • ¼ ¾", "Yewdаle Pinnасe", "ﬁle ﬂow", "a​b \xa0c", "plain", ""):
        assert model.find(t) is None, t


def test_lost_letters_do_not_keep_others_from_repair(model):
    bad = next(c for c in model.chains if c.name == "utf-8>cp1252").garble(SENTENCES[0])
    lost = "\n".join("".join(c if c.isascii() else "�" for c in s) for s in SENTENCES)
    text = f"{lost}\n{bad}\n{lost}"
    assert model.find(text)[0].read == "lost"
    assert model.repair(text)[0] == f"{lost}\n{SENTENCES[0]}\n{lost}"
    assert model.repair(lost) == (lost, [])


def test_more_than_four_chains(model):
    names = ["utf-8>cp1252", "utf-8>mac_roman", "utf-8>cp437", "utf-8>cp1251", "utf-8>cp1252x2", "utf-8>cp1250"]
    text = "\n".join(next(c for c in model.chains if c.name == n).garble(SENTENCES[0]) for n in names)
    restored, used = model.repair(text)
    assert len(used) > 4 and restored.split("\n").count(SENTENCES[0]) > 4, used


def test_table(spark, model):
    chain = model.chains[1]
    rows = [(1, SENTENCES[0], "x"), (2, chain.garble(SENTENCES[0]), "x"), (2, chain.garble(SENTENCES[0]), "x"), (3, None, "x"), (4, "", "x"), (None, "Z�rich", "x"), (5, "ok " * 50000 + chain.garble(SENTENCES[1]), "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, chain string")
    got = find_garbled(df, "doc_id", "text", model).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 2, 2, 5]
    assert {r.restored for r in got if r.doc_id == 2} == {SENTENCES[0]} and {r.restored for r in got if r.doc_id is None} == {None}
    assert find_garbled(df.limit(0), "doc_id", "text", model).count() == 0
    assert find_garbled(df.limit(0), "doc_id", "text").count() == 0


def test_only_the_verified_stretch_is_inverted(model):
    """A word that a single-byte chain would change stays where nothing around speaks for the chain."""
    chain = Chain("mac_roman", "cp1252", 1)
    clean = "Zürich und Köln, für die Prüfung der Übernahme und die Geschäfte"
    text = chain.garble(clean) + "\n" + "plain words only. " * 40 + "\nŽilina"
    restored, used = model.repair(text)
    assert restored.endswith("\nŽilina")
    if used:
        assert restored.startswith(clean)
