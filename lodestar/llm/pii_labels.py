"""Labelled text for training the tagger of personal information; nothing here is used to find any.

Three sources of labels: names of known people where they stand in the sample, the commonest written
forms of the other types, and phrases with invented values, whose spans are known by construction.
The last also hold spellings, captions and streets that no pattern below knows, and numbers that are
no personal information.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from .mojibake import Chain

TYPES = ["name", "email", "phone", "id", "address"]

# ------------------------------------------------------------------ written forms of the types

#: Words for identity documents, whose number follows.
ID_CAPTIONS = (
    r"National Insurance|NI number|Passport(?: No)?|Passeport|Reisepass|Pasaporte|Passaporto|NIF|SSN|Tax ID|DNI|"
    r"National ID|ID card|Social security no\.?|Social Security Number|Steuer-?ID|Personalausweis|Codice fiscale|ID"
)
#: Kinds of streets.
STREETS = r"Road|Rd|Street|St|Avenue|Ave|Lane|Ln|Close|Court|Ct|Drive|Dr|Terrace|Place|Pl|Square|Sq|Way|Gardens|Grove|Crescent|Hill|Row|Mews|Walk|Park"
_CAP = r"[^\W\d_][\w’'\-]+"
#: The sign of an ordinal, or what a wrong encoding has made of it.
_ORDINAL = r"[^\s\d,;|.]{1,8}"
FORMS = {
    "email": re.compile(
        r"(?<![\w.%+\-])[\w.%+\-]+(?:[ ]?[\[(]at[\])][ ]?|[ ]?@[ ]?)[A-Za-z0-9\-]+(?:(?:\.|[ ]?[\[(]dot[\])][ ]?)[A-Za-z0-9\-]+)+", re.I
    ),
    "phone": re.compile(
        r"(?<![\w./+\-])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,5}(?:[ .\-]?\d{2,6}){1,5}|00\d{2}[ .\-]\d{2,5}(?:[ .\-]\d{2,6}){1,4}"
        r"|\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}|0\d{2,4} \d{3,4} \d{4})(?![\w/]|[.\-]\d)"
    ),
    "id": re.compile(rf"(?<![\w])(?:{ID_CAPTIONS})[ :]{{1,2}}(?=[A-Z\d ]*\d)((?:[A-Z]{{1,3}} ?)?\d(?:[ \-]?\d){{5,12}}(?: ?[A-Z])?)(?![\w]|[.\-/]\d)", re.I),
    "address": re.compile(
        rf"(?<![\w/])(?:(?:(?:Flat|Apt|Unit|Suite) \d{{1,4}}[A-Za-z]?, )?\d{{1,4}}[a-z]? {_CAP}(?: {_CAP})? (?:(?:St|Rd|Ave|Ln|Ct|Dr|Pl|Sq)\.|(?:{STREETS})\b)"
        rf"|\d{{1,4}}(?: bis| ter)? (?:rue|avenue|boulevard|place|chemin|quai) (?:(?:de la|de l[’']|des|du|de|d[’']) ?)?{_CAP}(?:-{_CAP})*"
        rf"|(?:C/|Calle|Avda\.?|Plaza) (?:(?:de la|de los|de las|del|de) )?{_CAP},? \d{{1,4}}(?:, \d{{1,2}}{_ORDINAL}(?: [A-Z]\b)?)?"
        rf"|(?:Rua|Avenida|Travessa|Largo) (?:(?:da|do|das|dos|de) )?{_CAP},? \d{{1,4}}(?:, \d{{1,2}}{_ORDINAL}(?: [A-Z]\b)?)?"
        rf"|(?:Via|Viale|Piazza|Corso) (?:(?:della|delle|degli|dello|dei|del|di) )?{_CAP},? \d{{1,4}}"
        r"|(?-i:[A-ZÀ-Þ])[\w\-]*(?:stra[^\s\d]{1,8}e|gasse|weg|platz|allee) \d{1,4}[a-z]?)(?![\w])",
        re.I,
    ),
}


def form_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans in the written forms of the types other than name, longest first where they overlap."""
    out = []
    for kind, pattern in FORMS.items():
        for m in pattern.finditer(text):
            a, b = m.span(1) if kind == "id" else m.span()
            if kind == "phone" and not 7 <= sum(map(str.isdigit, text[a:b])) <= 15:
                continue
            out.append((a, b, kind))
    out.sort(key=lambda s: (s[0] - s[1], s[0]))
    kept: list[tuple[int, int, str]] = []
    for s in out:
        if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
            kept.append(s)
    return sorted(kept)


class NameForms:
    """Labels the names of known people, in the ways a name is written, for training."""

    def __init__(self, full_names: list[str]) -> None:
        given, family = set(), set()
        for n in full_names:
            words = [w for w in n.split() if len(w.strip(".")) > 1]
            if len(words) > 1:
                given |= set(words[0].split("-"))
                family |= set(words[1:])
        self.given, self.family = sorted(given), sorted(family)
        both = lambda ws: "|".join(re.escape(v) for w in sorted(ws, key=len, reverse=True) for v in (w, w.upper())) or "(?!)"
        g, f, gap = rf"(?:{both(given)})(?:-(?:{both(given)}))?", rf"(?:{both(family)})", "[ \xa0]"
        initial = rf"(?:{gap}[A-ZÀ-Þ]\.)?"
        self.pattern = re.compile(
            rf"(?<![\w&-])(?<!& )(?:{g}{initial}{gap}{f}(?:{gap}{f})?|{f},{gap}{g}{initial}|[A-ZÀ-Þ]\.{gap}{f})(?![\w-])(?!{gap}(?:&|and){gap}[A-ZÀ-Þ])"
        )

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        return [(*m.span(), "name") for m in self.pattern.finditer(text)]


# ------------------------------------------------------------------ invented phrases

_SYLLABLES = "ba cor del fen gar hal ir jan kel lor mon nav or pel quen ras sel tor ul van wen xi yor zan bri cas dun eth".split()
#: Words around the values in invented phrases.
_CONTACT = ["contact {}", "Contact: {}", "call {}", "Call {} or write.", "Spoke to {} today", "Referee: {}", "regards, {}", "Dear {}", "ask for {}", "Assistant is {}.", "met {} at the fair", "signed {}", "c/o {}", "Reference from {}, who knows the desk", "References {}", "Referencias {}", "Références {}", "Referenzen {}", "Referenze {}, Desk Head", "{} Leeds", "{} London | home", "{} for details"]
_MAIL = ["Email: {}", "E-mail {}", "mail {}", "write to {} soon", "{}", "<{}>", "{} | home", "({})", "reach me via {}.", "E: {}", "e {} m none", "Mail {} or call"]
_CALL = ["Tel. {}", "Phone: {}", "Mobile {}", "call {} after six", "{}", "{} ext. 41", "T: {} | F: none", "({})", "Ring {}.", "tel:{}", "{}  #3", "{}   #2 of #2", "#2. {}"]
_CAPTIONS = ["Driving licence", "Driver's license no.", "Passport", "ID", "ID no.", "NI number", "Tax ID", "Tax number", "National ID", "Residence permit", "Work permit no", "Identity card", "Social security", "CPF", "Codice fiscale", "Führerschein", "Carte d'identité", "DNI", "NIE", "Visa no."]
_LIVES = ["Lives at {}", "Address: {}", "Wohnhaft {}", "{}", "{}, London", "based in {}, Porto", "Home: {}", "Sitz {} | Berlin", "moved to {} last year.", "Post an {}."]
_NO_CASE = ["ISSN {4}-{4}", "Invoice {7}", "Order {6}", "Working paper no. {4}.{4}", "Ref {8}", "Ticket {3}-{5}", "page {2} of {3}", "v{1}.{2}.{3}", "Desk code {4}/{4}, seat {2}", "ISBN 978-{1}-{4}-{4}-{1}", "Book value {2} {4} 000", "Build {2}.{2}.{2}.{2}", "room {2}", "list v{2} @ close {4}", "fund {3} series {2}", "Req. ref {4}-{4}-{2}", "worth {3},{3},000", "pp. {2}-{4}", "@ {2}.{2} per share", "EUR {3} {3}", "#{h}", "ref {h}", "#{h} Lyon", "(20{2}-0{1} – 20{2}-1{1})", "20{2}-0{1} – present", "Sept.20{2}"]
_STREET_WORDS = "Road Street Avenue Lane Close Court Drive Terrace Place Square Way Gardens Boulevard Rise Parade Quay Mews Hill Rd. St. Ave. Ln.".split()


def invented_word(rng: np.random.Generator) -> str:
    return "".join(_SYLLABLES[i] for i in rng.integers(0, len(_SYLLABLES), int(rng.integers(2, 4))))


def _pick(rng: np.random.Generator, options: list[str]) -> str:
    return options[int(rng.integers(len(options)))]


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _email(rng: np.random.Generator) -> str:
    a, b = invented_word(rng), invented_word(rng)
    local = _pick(rng, [a, f"{a}.{b}", f"{a[0]}{b}", f"{a}_{b}", f"{a}-{b}", f"{a}{_digits(rng, 2)}", f"{a}.{b}+cv"])
    host = [invented_word(rng), *([invented_word(rng)] if rng.random() < 0.3 else []), _pick(rng, ["com", "org", "net", "example", "de", "fr", "io", "co.uk"])]
    at = _pick(rng, ["@", "@", "@", " at ", "[at]", "(at)", " (at) ", " [at] ", " @ "])
    dot = "." if at in ("@", " @ ") else _pick(rng, [".", " dot ", "[dot]", "(dot)", " (dot) "])
    if at == " at ":
        dot = " dot "
    return local + at + dot.join(host)


def _phone(rng: np.random.Generator) -> str:
    d = lambda n: _digits(rng, n)
    gap = _pick(rng, [" ", "-", ".", " "])
    return _pick(rng, [f"+{d(2)} {d(4)} {d(6)}", f"+{d(2)}{d(9)}", f"({d(3)}) {d(3)}-{d(4)}", gap.join([d(3), d(3), d(4)]), f"+{d(2)} (0){d(2)} {d(4)} {d(3)}", gap.join(["0" + d(1), d(2), d(2), d(2), d(2)]), f"0{d(3)} {d(3)} {d(4)}", f"00{d(2)}{gap}{d(3)}{gap}{d(6)}", f"0{d(3)}/{d(7)}"])


def _identity(rng: np.random.Generator) -> str:
    d = lambda n: _digits(rng, n)
    letter = lambda n: "".join(chr(65 + int(x)) for x in rng.integers(0, 26, n))
    return _pick(rng, [letter(1) + d(7), letter(2) + d(7), d(8) + letter(1), d(7), d(9), f"{d(3)}-{d(2)}-{d(4)}", f"{letter(2)} {d(2)} {d(2)} {d(2)} {letter(1)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", letter(3) + d(6), f"{letter(1)}-{d(7)}-{letter(1)}", d(11)])


def _address(rng: np.random.Generator) -> str:
    w = invented_word(rng).capitalize()
    n = str(int(rng.integers(1, 300))) + (_pick(rng, ["a", "b"]) if rng.random() < 0.1 else "")
    return _pick(rng, [
        f"{n} {w} {_pick(rng, _STREET_WORDS)}", f"{n} {w} {_pick(rng, _STREET_WORDS)}", f"Flat {rng.integers(1, 60)}, {n} {w} {_pick(rng, _STREET_WORDS)}", f"Apt {rng.integers(1, 60)}B, {n} {w} Boulevard",
        f"Am {w} {n}", f"An der {w} {n}", f"Am Markt {n}", f"Im {w}feld {n}", f"{w}{_pick(rng, ['straße', 'strasse', 'weg', 'gasse', 'platz', 'allee', 'ring', 'ufer', 'damm'])} {n}", f"{w}er Straße {n}",
        f"{n} {_pick(rng, ['rue', 'avenue', 'place', 'impasse', 'allée', 'chemin'])} {_pick(rng, ['de la ', 'du ', 'des ', ''])}{w}", f"{n} bis rue de {w}",
        f"{_pick(rng, ['Rua', 'Calle', 'Via', 'Viale', 'Travessa', 'Paseo', 'Piazza', 'Avenida'])} {_pick(rng, ['do ', 'de la ', 'del ', ''])}{w}{_pick(rng, [', ', ' '])}{n}", f"C/ {w} {n}, {rng.integers(1, 9)}º {_pick(rng, ['A', 'B', 'D'])}",
    ])


Piece = tuple[str, int]


def phrase(names: list[str], rng: np.random.Generator) -> list[Piece]:
    """An invented phrase as pieces, each with its tag."""
    kind = int(rng.integers(0, 7))
    if kind >= 5:
        frame = re.sub(r"\{(\d)\}", lambda m: _digits(rng, int(m[1])), _pick(rng, _NO_CASE))
        return [(frame.replace("{h}", f"{int(rng.integers(2**40)):010x}"), 0)]
    if kind == 3:
        return [(_pick(rng, _CAPTIONS) + _pick(rng, [" ", ": ", " "]), 0), (_identity(rng), 4), (_pick(rng, ["", ".", ", seen", " | ok"]), 0)]
    frame = _pick(rng, [_CONTACT, _MAIL, _CALL, [], _LIVES][kind])
    beside: list[Piece] = []
    if kind == 0:
        value = _pick(rng, names) if names and rng.random() < 0.4 else f"{invented_word(rng).capitalize()} {invented_word(rng).capitalize()}"
        draw = rng.random()
        if draw < 0.4:  # nobody types capitals in a hurry
            value, frame = value.lower(), frame.lower()
        elif draw < 0.45:
            value = value.upper()
    else:
        value = (_email, _phone, None, _address)[kind - 1](rng)
        if rng.random() < 0.35:  # whose it is, right before it
            whose = _pick(rng, names) if names else f"{invented_word(rng).capitalize()} {invented_word(rng).capitalize()}"
            beside, frame = [(whose, 1), (_pick(rng, [" ", "  ", ", ", " (", " – ", ": ", "\n", " | "]), 0)], _pick(rng, ["{}", "{}", "{})", "{}."])
    if value.endswith("."):  # one point, which ends the street's kind
        frame = frame.replace("{}.", "{}")
    before, after = (re.sub(r"#(\d)", lambda m: _digits(rng, int(m[1])), x) for x in frame.split("{}"))
    return [*beside, (before, 0), (value, 1 + kind), (after, 0)]


Span = tuple[int, int, str]
_GARBLED = [("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "mac_roman", 1), ("utf-8", "cp1251", 1), ("utf-8", "cp437", 1), ("utf-8", "cp1252", 2), ("mac_roman", "cp1252", 1), ("cp1252", "cp1251", 1), ("utf-8", "cp1250", 1), ("cp1252", "lost", 1)]


def variant(text: str, spans: list[Span], names: list[str], rng: np.random.Generator) -> tuple[str, np.ndarray]:
    """A text with some names invented, some case changed, some garbled, phrases put in, and its tags."""
    pieces: list[Piece] = []
    last = 0
    invent = rng.random() < 0.3
    for a, b, kind in spans:
        pieces.append((text[last:a], 0))
        pieces.append((_reworded(text[a:b], kind, invent, rng), 1 + TYPES.index(kind)))
        last = b
    pieces.append((text[last:], 0))
    pieces = _with_phrases(pieces, names, rng)
    draw = rng.random()
    if draw < 0.05:
        pieces = [(p.upper(), k) for p, k in pieces]
    elif draw < 0.13:
        chain = Chain(*_GARBLED[int(rng.integers(len(_GARBLED)))])
        pieces = [(chain.garble(p), k) for p, k in pieces]
    return "".join(p for p, _ in pieces), np.concatenate([np.full(len(p), k, np.int8) for p, k in pieces])


def _reworded(part: str, kind: str, invent: bool, rng: np.random.Generator) -> str:
    made: Callable[[re.Match], str] = lambda m: invented_word(rng).upper() if m[0].isupper() else invented_word(rng).capitalize()
    if kind == "name" and not invent and rng.random() < 0.1:
        part = re.sub(r"^([^\W\d_])[\w’'-]+(?: [^\W\d_]\.)? (?=[^\W\d_]+$)", r"\1. ", part)
    if kind == "address" and rng.random() < 0.5:
        part = re.sub(r"\b[^\W\d_]{3,}?(?=(?:straße|strasse|gasse|weg|platz|allee)\b)", made, part)
    if kind == "name" and invent:
        part = re.sub(r"[^\W\d_]{3,}", made, part)
    return part


#: Share of the line ends of a text at which an invented phrase is put in, and of one more than that.
_PHRASES = 0.04


def _with_phrases(pieces: list[Piece], names: list[str], rng: np.random.Generator) -> list[Piece]:
    """Invented phrases after some lines, each on a line of its own or after a sentence."""
    out: list[Piece] = []
    for text, tag in pieces:
        if tag:
            out.append((text, tag))
            continue
        last = 0
        for m in re.finditer(r"\n|(?<=[.,;]) ", text):
            if rng.random() < _PHRASES:
                out += [(text[last : m.end()], 0), *phrase(names, rng), (m[0], 0)]
                last = m.end()
        out.append((text[last:], 0))
    return out
