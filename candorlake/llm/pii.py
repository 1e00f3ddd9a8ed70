"""Personal data: high-recall candidates, boosted trees over their format and context, calibrated limits.

Base spans of four kinds follow fixed patterns and always count. Generators propose further spans, also
overlapping ones, in forms that the patterns miss: spelled-out mail addresses, telephone numbers without a
plus sign, numbers in unusual groups, addresses with bracketed dots, bank accounts, national ids. Where numbers stand side by side, every stretch of
whole groups of digits is proposed besides the whole. A boosted
forest scores each candidate by its format and by the words around it. It is trained on labelled
examples that ``examples`` makes (no table holds labelled spans): personal data in many forms, and dates,
versions, prices, sizes, article and serial numbers that look alike, in sentences with and without hints. Half of
the examples train the forest, a quarter makes the curve from its scores to probabilities, and the last quarter
sets, for each kind, the lowest probability from an even chance on at which PRECISION of what is selected is right. Of overlapping
candidates the likeliest is selected, of equally likely ones the first, then the longest; none may overlap a base
span.

Edge cases: null text counts as empty; an empty text has no spans; all scans are linear in a text's length,
for long runs of digits, dots or letters too; repeated rows and null ids are rows like others; an empty
table gives an empty result; other columns of the input, of whatever name, are ignored.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from candorlake.llm import gbt
from candorlake.llm.spans import Finder, Span, disjoint, find_spans

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
PRECISION, EVEN = 0.98, 0.5
EXAMPLES, SEED = 9000, 11
CONTEXT = 40

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")

_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\[at\]|\(at\)|\{at\}| at ) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}| dot ) ?[A-Za-z0-9-]++)++", re.I)
_SPELLED_HINT = re.compile(r"dot|[\[({]at[\])}]|@ | @", re.I)
_DIGITS, _BETWEEN = "0123456789", "().\x20/_-+"
_GROUP = re.compile(r"[0-9]+")
_NUMBERS = re.compile(r"[+(]?[0-9](?:[0-9().\x20/_-]*[0-9])?")
_DOTTED = re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)) ?[0-9]{1,3}){3}(?![0-9])", re.I)
_SIX = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}:?(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Words that stand near personal data of each kind, and near numbers that are none.
HINTS = {
    "email": ("mail", "e-mail", "contact", "write", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "login", "adresse", "servidor", "serveur"),
    "card": ("card", "visa", "credit", "karte", "tarjeta", "carte", "mastercard", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone", "ring"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security", "insurance", "tax"),
    "none": ("version", "isbn", "order", "item", "page", "price", "date", "serial", "part", "model", "release", "invoice", "sku", "lot", "build", "issue", "chapter", "section"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_emails(text: str) -> list[Span]:
    """Leftmost matches of local part, @ and dotted domain; each @ is looked at once."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            out.append(Span("email", start, done))
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by kind as in KINDS, then by start."""
    if not _HINT.search(text):
        return []
    out = base_emails(text)
    out += [Span("ip", *m.span()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(Span("card", *m.span()))
    if "+" in text:
        out += [Span("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def candidates(text: str) -> list[Span]:
    """Everything that may be personal data, also overlapping."""
    out = []
    if _SPELLED_HINT.search(text):
        out += [Span("email", *m.span(), False) for m in _SPELLED.finditer(text)]
    if not _HINT.search(text):
        return out
    for m in _NUMBERS.finditer(text):
        n = sum("0" <= c <= "9" for c in m[0])
        if 12 <= n <= 19:
            out.append(Span("card", *m.span(), False))
        if 7 <= n <= 15:
            out.append(Span("phone", *m.span(), False))
        if n == 9 and len(m[0]) >= 11:
            out.append(Span("ssn", *m.span(), False))
        out += _parts(text, *m.span())
    if "." in text and ("[" in text or "(" in text) or "dot" in text:
        out += [Span("ip", *m.span(), False) for m in _DOTTED.finditer(text)]
    if text.count(":") >= 3:
        out += [Span("ip", *m.span(), False) for m in _SIX.finditer(text)]
    out += [Span("iban", *m.span(), False) for m in _IBAN.finditer(text)]
    return out


def _parts(text: str, start: int, end: int) -> list[Span]:
    """Stretches of a run of numbers from one group of digits to another, of up to 19 digits and less than the run;
    as cards only those whose check digit is right."""
    groups = [m.span() for m in _GROUP.finditer(text, start, end)]
    if len(groups) < 2:
        return []
    # Sums of the digits before each place, those at even or odd places doubled: luhn() of any stretch.
    sums, places = ([0], [0]), [0]
    for a, b in groups:
        for c in text[a:b]:
            d = ord(c) - 48
            twice = 2 * d - 9 if d > 4 else 2 * d
            even = len(sums[0]) % 2 == 1
            sums[0].append(sums[0][-1] + (twice if even else d))
            sums[1].append(sums[1][-1] + (d if even else twice))
        places.append(len(sums[0]) - 1)
    out = []
    for i, (a, _) in enumerate(groups):
        while a > start and text[a - 1] in "+(":
            a -= 1
        for j in range(i, len(groups)):
            n = places[j + 1] - places[i]
            if n > 19:
                break
            if n < 7 or i == 0 and j == len(groups) - 1:
                continue
            b = groups[j][1]
            own = sums[places[j + 1] % 2]
            if n >= 12 and (own[places[j + 1]] - own[places[i]]) % 10 == 0:
                out.append(Span("card", a, b, False))
            if n <= 15:
                out.append(Span("phone", a, b, False))
            if n == 9 and b - a >= 11:
                out.append(Span("ssn", a, b, False))
    return out


def _beside(rest: str, own: str, before: bool) -> list[float]:
    """Of the number next to a candidate: digits of its nearest group, whether what parts them is white, and whether
    it also parts the candidate's groups."""
    bare = rest.rstrip(_BETWEEN) if before else rest.lstrip(_BETWEEN)
    left = bare.rstrip(_DIGITS) if before else bare.lstrip(_DIGITS)
    if len(left) == len(bare):
        return [0.0, 0.0, 0.0]
    mark = (rest[len(bare) :] if before else rest[: len(rest) - len(bare)]).strip("+(")
    return [float(len(bare) - len(left)), float(" " in mark), float(mark in own)]


def _iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, s: Span) -> list[float]:
    """What the forest sees of a candidate: its form, the characters at its ends, the words around it."""
    own = text[s.start : s.end]
    before, after = text[max(0, s.start - CONTEXT) : s.start], text[s.end : s.end + CONTEXT]
    near = set(re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", f"{before} {after}".lower()))
    digits = "".join(c for c in own if "0" <= c <= "9")
    groups = [len(g) for g in re.findall("[0-9]+", own)] or [0]
    marks = [own.count(c) for c in " -.()/_:[@"]
    domain = re.split(r"[.\s\[\](){}]+", own.rstrip())[-1].lower() if s.kind == "email" else ""
    return [
        *[float(s.kind == k) for k in KINDS],
        len(own), len(digits), len(groups), groups[0], groups[-1], max(groups), min(groups),
        *marks,
        float(own[:1] == "+"), float(own[:1] == "("), float(own[:1] == "0"), float(own[:2] in ("19", "20")), float(own[:1] in "3456"),
        float(bool(digits) and luhn(digits)), float(s.kind == "iban" and _iban_valid(own)), float(all(g <= 4 for g in groups)),
        float(" at " in own), float("[" in own or "(" in own), float(domain in ("com", "org", "net", "edu", "de", "fr", "es", "uk", "io", "info")), float(domain.isalpha() and 2 <= len(domain) <= 4),
        len(set(digits)) / max(1, len(digits)), math.log1p(len(own)),
        *[float(bool(near & set(HINTS[k]))) for k in (*KINDS, "none")],
        float(bool(near & set(HINTS[s.kind]))),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in tuple("$€£#")), float(after[:1] in tuple("%€$")), float(before.rstrip()[-1:] == ":"), float(before[-1:] in tuple(".-/")), float(after[:1] in tuple("-/_")),
        *_beside(before, own, True), *_beside(after, own, False),
    ]


def _personal(r: random.Random) -> tuple[str, str]:
    """(kind, text) of made-up personal data in forms that the fixed patterns mostly miss."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    kind = r.choice(KINDS)
    if kind == "email":
        at, dot = r.choice([(" at ", " dot "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" @ ", "."), ("[at]", "."), (" (at) ", ".")])
        name = r.choice([word(), word() + "." + word(), word() + d(2)])
        return kind, name + at + word() + dot + r.choice(["com", "org", "net", "de", "fr", "es", "io", "edu"])
    if kind == "phone":
        return kind, r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{r.choice('23456789')}{d(2)}-{d(3)}-{d(4)}", f"{r.choice('23456789')}{d(2)}.{d(3)}.{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"00{d(2)} {d(3)} {d(6)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"0{d(4)}/{d(6)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"])
    if kind == "card":
        body = r.choice("3456") + d(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = r.choice([".", "/", "  ", "_", " - "])
        return kind, sep.join(body[i : i + 4] for i in range(0, 16, 4))
    if kind == "ip":
        octets = [str(r.randint(1, 254)) for _ in range(4)]
        return kind, r.choice(["[.]".join(octets), "[dot]".join(octets), " (dot) ".join(octets), ":".join(f"{r.randint(256, 65535):x}" for _ in range(8))])
    if kind == "ssn":
        return kind, f"{r.randint(100, 772)}-{r.randint(10, 99)}-{d(4)}"
    body = r.choice(["DE", "FR", "ES"]), d(18)
    check = 98 - int("".join(str(int(c, 36)) for c in body[1] + body[0] + "00")) % 97
    whole = f"{body[0]}{check:02d}{body[1]}"
    return kind, whole if r.random() < 0.5 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))


def _harmless(r: random.Random) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    year, month, day = r.randint(1900, 2035), r.randint(1, 12), r.randint(1, 28)
    return r.choice([
        f"{year}-{month:02d}-{day:02d}", f"{day:02d}/{month:02d}/{year}", f"{day:02d}.{month:02d}.{year}", f"{year}-{month:02d}-{day:02d} {r.randint(0, 23):02d}", f"{year}-{year + r.randint(1, 9)}",
        f"{r.randint(1, 30)}.{r.randint(0, 30)}.{r.randint(0, 999)}", f"{r.randint(1, 9)}.{r.randint(300, 999)}.{r.randint(0, 99)}.{d(5)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"978{d(10)}", d(7), d(8), d(9), d(10), d(12), d(14), d(16),
        f"{d(3)} {d(3)} {d(3)}", f"{r.randint(1, 999)}.{d(3)}.{d(3)}", f"{d(4)}-{d(4)}", f"{d(2)}-{d(5)}-{d(2)}", f"{r.randint(2, 99)} - {r.randint(100, 999)} - {d(4)}", f"{d(3)}/{d(4)}", f"{d(5)} {d(5)} {d(5)}",
        f"meet {r.choice(['me', 'us', 'them'])} at noon dot dot dot", "polka dot at night dot by dot", f"see {r.choice(['us', 'it'])} at home dot", f"{r.randint(10, 23)}:{d(2)}:{d(2)}:{d(2)}", f"{d(2)}:{d(2)}:{d(2)}.{d(3)}",
        f"{r.choice(['AB', 'XR', 'PN', 'QT'])}{d(2)} {d(4)} {d(4)} {d(4)}", f"{r.choice(['AB', 'XR', 'PN'])}{d(12)}", f"+{d(2)}", f"({d(1)}) {d(3)}, ({d(1)}) {d(3)}", ", ".join(d(2) for _ in range(5)), " ".join(d(2) for _ in range(6)), " ".join(d(1) for _ in range(9)),
    ])


def _neighbours(r: random.Random) -> tuple[list[tuple[str, str]], str]:
    """([(kind, text)], mark between them) of numbers side by side, of which some are personal data."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = d(15)
        body += next(c for c in "0123456789" if luhn(body + c))
        return r.choice(["", "", " ", "-", "."]).join(body[i : i + 4] for i in range(0, 16, 4)) if r.random() < 0.7 else body

    makes = [
        lambda: ("card", card()), lambda: ("card", card()), lambda: ("phone", f"+{r.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}"), lambda: ("phone", f"({d(3)}) {d(3)}-{d(4)}"), lambda: ("phone", f"{r.choice('23456789')}{d(2)}-{d(3)}-{d(4)}"),
        lambda: ("phone", f"{r.choice('23456789')}{d(2)}.{d(3)}.{d(4)}"), lambda: ("phone", f"0{d(4)}/{d(6)}"), lambda: ("ssn", f"{r.randint(100, 772)}-{r.randint(10, 99)}-{d(4)}"), lambda: ("none", ".".join(str(r.randint(1, 254)) for _ in range(4))),
        lambda: ("none", f"{r.randint(1, 12):02d}/{r.randint(20, 35)}"), lambda: ("none", f"{r.randint(1990, 2035)}"), lambda: ("none", d(r.randint(1, 5))), lambda: ("none", f"{r.randint(1990, 2035)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"),
    ]
    return [r.choice(makes)() for _ in range(r.choice([2, 2, 3]))], r.choice([" ", " ", " ", "  ", " - ", " / "])


_FILL = ("the", "of", "and", "to", "in", "was", "le", "der", "que", "with", "for", "on", "please", "our", "new", "la", "und", "les", "at", "by")


def _same(c: Span, start: int, end: int) -> bool:
    """Whether a candidate is that stretch: exactly for numbers, of which others are part, else by 80 %."""
    if c.kind in ("card", "phone", "ssn"):
        return (c.start, c.end) == (start, end)
    return max(0, min(c.end, end) - max(c.start, start)) >= 0.8 * max(end - start, c.end - c.start)


def examples(count: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, Span, int]]:
    """(text, candidate, 1 if it is the personal data in that text)."""
    r = random.Random(seed)
    out = []
    for _ in range(count):
        words = [r.choice(_FILL) for _ in range(r.randint(4, 16))]
        personal = r.random() < 0.5
        kind, own = _personal(r) if personal else ("none", _harmless(r))
        if not personal and r.random() < 0.05:
            kind = r.choice(KINDS)  # a misleading hint
        pieces, mark = [(kind if personal else "none", own)], ""
        if r.random() < 0.12:
            pieces, mark = _neighbours(r)
            kind, own = r.choice(pieces)[0], mark.join(piece for _, piece in pieces)
        at = r.randint(0, len(words))
        hint = [r.choice(HINTS[kind]) + r.choice(["", ":", " is", " number", " no."])] if r.random() < 0.55 else []
        left, right = " ".join(words[:at] + hint), " ".join(words[at:])
        text = f"{left} {own}{r.choice(['', '.', ',', ''])} {right}".strip()
        start = text.index(own, max(0, len(left) - 1))
        true = []
        for k, piece in pieces:
            true.append((k, start, start + len(piece)))
            start += len(piece) + len(mark)
        for c in candidates(text):
            out.append((text, c, int(any(c.kind == k and _same(c, a, b) for k, a, b in true))))
    return out


class Model(NamedTuple):
    forest: gbt.Forest
    #: Log-odds to probability: slope and offset; and the least probability for each kind.
    slope: float
    offset: float
    limits: dict[str, float]


def _probability(z: np.ndarray, slope: float, offset: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * z + offset, -40, 40)))


@lru_cache(maxsize=1)
def trained() -> Model:
    made = examples()
    texts = {t: i for i, t in enumerate(dict.fromkeys(t for t, *_ in made))}
    # Most stretches of numbers are wrong ones: the forest learns from every fourth, the curve below from all.
    made = [m for i, m in enumerate(made) if texts[m[0]] % 2 or m[2] or m[1].kind not in ("card", "phone", "ssn") or i % 4 == 0]
    x, y = np.array([features(t, c) for t, c, _ in made]), np.array([v for *_, v in made])
    part = np.array([texts[t] % 4 for t, *_ in made])  # 0 and 2: the forest, 1: the curve, 3: the limits
    forest = gbt.fit(x[part % 2 == 0], y[part % 2 == 0])
    z, t = gbt.log_odds(forest, x[part == 1]), y[part == 1]
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Platt's curve by Newton's steps
        p = _probability(z, slope, offset)
        g = np.array([((t - p) * z).sum(), (t - p).sum()])
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * z * z).sum(), (w * z).sum()], [(w * z).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        slope, offset = np.array([slope, offset]) + np.linalg.solve(h, g)
    last = part == 3
    p, t = _probability(gbt.log_odds(forest, x[last]), slope, offset), y[last]
    kinds = np.array([c.kind for _, c, _ in made])[last]
    return Model(forest, float(slope), float(offset), {kind: limit_of(p[kinds == kind], t[kinds == kind]) for kind in KINDS})


def limit_of(p: np.ndarray, t: np.ndarray) -> float:
    """The lowest probability from which on PRECISION of the candidates are right, with a standard deviation of the
    wrong ones' number to spare for candidates not seen, and which is an even chance itself; over 1 if there is none.
    Examples are easier to tell apart than what the world holds: below an even chance the curve knows few cases."""
    order = np.argsort(-p, kind="stable")
    n = np.arange(1, len(order) + 1)
    precise = np.flatnonzero(np.cumsum(1 - t[order]) <= n * (1 - PRECISION) - np.sqrt(n * PRECISION * (1 - PRECISION)))
    return max(EVEN, float(p[order[precise[-1]]])) if len(precise) else 1.1


def _scores(model: Model, text: str, proposed: list[Span]) -> np.ndarray:
    """The candidates' probabilities; those that look alike, as in long runs, are scored once."""
    place: dict[tuple, int] = {}
    first: list[Span] = []
    at = []
    for c in proposed:
        key = (c.kind, text[max(0, c.start - CONTEXT) : c.start], text[c.start : c.end], text[c.end : c.end + CONTEXT])
        k = place.setdefault(key, len(first))
        if k == len(first):
            first.append(c)
        at.append(k)
    z = [gbt.log_odds(model.forest, np.array([features(text, c) for c in first[i : i + 4096]])) for i in range(0, len(first), 4096)]
    return _probability(np.concatenate(z), model.slope, model.offset)[at]


def finder(model: Model) -> Finder:
    rank = {k: i for i, k in enumerate(KINDS)}

    def find(texts: list[str]) -> list[list[Span]]:
        out = []
        for text in texts:
            fixed = base_spans(text)
            spans = fixed
            proposed = candidates(text)
            if proposed:
                p = _scores(model, text, proposed)
                chosen = [c._replace(probability=float(v)) for c, v in zip(proposed, p) if v >= model.limits[c.kind]]
                spans = sorted([*fixed, *disjoint(fixed, chosen)], key=lambda s: (rank[s.kind], s.start))
            out.append(spans)
        return out

    return find


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, spans) for each row, spans by kind as in KINDS, then by start."""
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())
    return find_spans(docs, lambda: finder(shared.value))
