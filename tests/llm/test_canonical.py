import random

from lodestar.llm.canonical import GramIndex, ListStatistics, abbreviates, allowed, edits, fold, map_values

FIRMS = [
    (1, "Yewdale Pinnace Consulting", ["YPCQ"]), (2, "Northgale Foundry Securities", []), (3, "Larkhill Orchard Asset Management", ["Lunstow Trust"]), (4, "Mavroux & Jarovec Bank", []),
    (5, "Castellan Meridian Partners", []), (6, "Northgale Orchard Bank", []),
]
TITLES = [(1, "Senior Credit Analyst", []), (2, "Credit Analyst", []), (3, "Managing Director", ["MD"]), (4, "Head of Research", []), (5, "Senior Quantitative Researcher", []), (6, "Quantitative Researcher", ["Quant Researcher"]), (7, "Vice President", ["VP"])]


def test_parts():
    assert fold("  Ðе Ünïon (London) & Co.") and fold("Саstellаn É") == "castellan e"
    assert [edits(a, b, 3) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "abxc"), ("abc", "xyz"), ("", "ab"))] == [0, 1, 1, 3, 2]
    assert abbreviates("mgr", "manager") and not abbreviates("mgr", "managing") and not abbreviates("x", "xy")


def test_firms():
    ix = GramIndex(FIRMS)
    cases = {
        "YEWDALE  PINNACE": 1, "YewdalePinnace Consult.": 1, "Yewdlae Pinnace Consulting SARL": 1, "ypcq": 1, "Consulting, Yewdale Pinnace": 1, "Equities desk, Northgale Fоundry Secs.": 2,
        "Larkhill Orchard A.M.": 3, "Lunstow Trust (contract)": 3, "Mavroux and Jarovec": 4, "Northgale Orchard": 6,
        "Northgale Bakery": 0, "Orchard Dental Care": 0, "Yewdale Foundry Consulting": 0, "Pinnace Consulting": 0, "": 0, "—": 0, "x" * 20_000: 0,
    }
    assert {k: ix.match(k)[0] for k in cases} == cases


def test_titles():
    ix = GramIndex(TITLES)
    cases = {"Sr. Credit Analyst": 1, "Analyst, Credit": 2, "Credit-Analyst [maternity cover]": 2, "md": 3, "Mg. Director": 3, "Head Of Rsch": 4, "Snr Quant. Res.er": 5, "V.P.": 7, "Choir Director": 0, "Head Chef": 0, "Vice Captain": 0}
    assert {k: ix.match(k)[0] for k in cases} == cases


def test_typed_with_errors():
    ix, rng, right = GramIndex(FIRMS), random.Random(4), 0
    for _ in range(300):
        ref, name, _ = rng.choice(FIRMS)
        at = rng.randrange(1, len(name) - 1)
        typed = rng.choice([name[:at] + name[at + 1 :], name[:at] + rng.choice("aeiou") + name[at:], name.upper(), name.lower()])
        right += ix.match(typed)[0] == ref
    assert right >= 294


def test_table(spark):
    rows = [("Yewdale Pinnace", 1, "r")] * 3 + [(None, 1, "r"), ("  ", 1, "r"), ("Nobody Ltd", 1, "r"), ("YPCQ", 1, "r")]
    values = spark.createDataFrame(rows, "value string, ref_id int, score string")
    reference = spark.createDataFrame([(*f, "clash") for f in FIRMS] + [(9, None, None, "clash"), (10, "Twin Firm", None, "c"), (11, "Twin Firm", None, "c")], "employer_id int, name string, aliases array<string>, value string")
    for block in (50_000, 3):
        got = {r.value: r.ref_id for r in map_values(values, "value", reference, "employer_id", "name", "aliases", block).collect()}
        assert got == {"Yewdale Pinnace": 1, "Nobody Ltd": 0, "YPCQ": 1}, block
    twin = spark.createDataFrame([("Twin Firm",)], "value string")
    assert map_values(twin, "value", reference, "employer_id", "name", "aliases").first().ref_id == 0
    assert map_values(values, "value", reference.limit(0), "employer_id", "name", "aliases").where("ref_id <> 0").count() == 0
    assert map_values(values.limit(0), "value", reference, "employer_id", "name").count() == 0


def test_closest_words_are_those_of_a_scan():
    """The pairs of letters lose no word that a comparison with the whole vocabulary finds."""
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(3, 9))) for _ in range(400)})
    names = ListStatistics([(1, w, []) for w in words])
    for _ in range(400):
        token = list(rng.choice(words))
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(token))
            token[i : i + 1] = rng.choice([[], ["a"], token[i : i + 1] * 2])
            if len(token) < 3:
                break
        token = "".join(token)
        near = [(edits(token, w, 2), w) for w in words if edits(token, w, 2) <= min(2, allowed(token), allowed(w))]
        if token in words:
            assert names.spelt(token) == (0, {token})
        elif near:
            assert names.spelt(token) == (min(near)[0], {w for e, w in near if e == min(near)[0]}), token
        else:
            assert names.spelt(token)[1] == frozenset()


def test_blocks_change_nothing(spark):
    """Rarity and the words that tell apart are those of the whole list, in every block."""
    typed = ["Yewdale Pinnace", "Northgale Fndry Securities", "Orchard Bank", "Larkhill Orchard Asset Mgmt", "Northgale Orchard", "Castellan Meridian", "Northgale"]
    values = spark.createDataFrame([(t,) for t in typed], "value string")
    reference = spark.createDataFrame(FIRMS, "employer_id int, name string, aliases array<string>")
    one, *rest = ({tuple(r) for r in map_values(values, "value", reference, "employer_id", "name", "aliases", n).select("value", "ref_id", "score").collect()} for n in (50_000, 4, 1))
    assert len(one) == len(typed) and all({(v, r) for v, r, _ in one} == {(v, r) for v, r, _ in x} for x in rest)
