"""Secrets: a character convolutional network over every candidate and its surroundings.

Base spans of three kinds follow fixed patterns and always count. Any further run of LEAST or more key characters
with letters and digits in it is a candidate, as are passwords in addresses and private key blocks. The
network sees the candidate and CONTEXT characters before and after it, with the candidate's
characters set apart from those around it. It is trained on labelled findings that ``examples`` makes (no
table holds any): keys of many makes as code, logs and prose hold them, and names, paths, hosts, versions,
checksums and numbers that look alike. Both stand behind the same words, so that it is the run that tells. Half
of the examples train the network; a quarter, by whole candidates, makes the curve from scores to probabilities;
the last quarter sets the limit on these: the lowest from an even chance on at which PRECISION of what is selected is
right, and none that finds less than RECALL of the keys, with two standard deviations to spare for keys not seen.

Edge cases: null text counts as empty; an empty text has no spans; all scans are linear in a text's length;
a candidate longer than the network's row is seen in overlapping windows and in its parts, and the likeliest of
them counts; of overlapping candidates the likeliest counts, of equally likely ones the first, then the longest;
repeated rows and null ids are rows like others; an empty table gives an empty result; redaction leaves other
columns, of whatever name, as they are.
"""

from __future__ import annotations

import math
import random
import re
import string
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from candorlake.llm import bytenet, spans
from candorlake.llm.spans import Finder, Span, disjoint, find_spans

KINDS = ("assign", "access", "hex", "key")
LEAST, CONTEXT, OWN = 16, 24, 48
ROW = OWN + 2 * CONTEXT
RECALL, PRECISION, EVEN = 0.97, 0.98, 0.5
EXAMPLES, SEED = 10_000, 5
WIDTHS, FILTERS, EPOCHS = (3, 5), 16, 8

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_HINT = re.compile(r"(?ai)passw|secret|token|api_?key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
_PART = re.compile(r"[A-Za-z0-9+_-]{16,}")
_URL = re.compile(r"(?<=://)[^\s:/@]++:[^\s:/@]{4,}+(?=@)")
_BEGIN = re.compile(r"-----BEGIN [^\n-]*PRIVATE KEY[^\n-]*-----")
_END = re.compile(r"-----END [^\n-]*-----")
_DIGIT = re.compile(r"[0-9]")


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns by start, then kind as in KINDS."""
    out = []
    if _ASSIGN_HINT.search(text):
        out += [Span("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [Span("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _DIGIT.search(text) or len(text) >= 32:
        out += [Span("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def _mixed(own: str) -> bool:
    return any("0" <= c <= "9" for c in own) and any(c.isalpha() for c in own)


def candidates(text: str) -> list[Span]:
    out = []
    if _DIGIT.search(text):
        for m in _RUN.finditer(text):
            if _mixed(m[0]):
                out.append(Span("key", *m.span(), False))
    if "://" in text:
        out += [Span("key", *m.span(), False) for m in _URL.finditer(text)]
    if "-----BEGIN " in text:
        ends = [m.end() for m in _END.finditer(text)]
        done = k = 0
        for m in _BEGIN.finditer(text):
            while k < len(ends) and ends[k] < m.end():
                k += 1
            if m.start() >= done and k < len(ends):
                done = ends[k]
                out.append(Span("key", m.start(), done, False))
    return out


def views(text: str, s: Span) -> list[Span]:
    """What the network sees of a candidate: all of it, or, if it is longer than OWN, windows of OWN characters
    that overlap by half, and its parts between slashes, dots and equals signs."""
    if s.end - s.start <= OWN:
        return [s]
    starts = [*range(s.start, s.end - OWN, OWN // 2), s.end - OWN]
    parts = [m.span() for m in _PART.finditer(text, s.start, s.end)]
    return [*[s._replace(start=a, end=a + OWN) for a in starts], *[s._replace(start=a, end=b) for a, b in parts if b - a <= OWN and _mixed(text[a:b])]]


def pictured(text: str, s: Span) -> np.ndarray:
    """ROW bytes: context, a view of a candidate, context; ASCII or 127, with 128 added around the view."""
    own = text[s.start : s.end]
    left, right = text[max(0, s.start - CONTEXT) : s.start], text[s.end : s.end + CONTEXT]
    row = np.full(ROW, 128 + 32, dtype=np.uint8)
    for at, piece, add in ((CONTEXT - len(left), left, 128), (CONTEXT, own, 0), (CONTEXT + OWN, right, 128)):
        if piece:
            codes = np.minimum(np.frombuffer(piece.encode("utf-32-le"), dtype=np.uint32), 127).astype(np.uint8)
            row[at : at + len(codes)] = codes + add
    row[CONTEXT + len(own) : CONTEXT + OWN] = 0
    return row


def _key(r: random.Random) -> str:
    some = lambda n, a: "".join(r.choice(a) for _ in range(n))
    alnum, lower = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits
    make = r.choice([
        lambda: "ghp_" + some(36, alnum), lambda: "sk_live_" + some(24, alnum), lambda: "sk-" + some(40, alnum), lambda: "xoxb-" + some(12, string.digits) + "-" + some(24, alnum), lambda: "AIza" + some(35, alnum + "-_"),
        lambda: "glpat-" + some(20, alnum), lambda: "eyJ" + some(20, alnum) + "." + some(30, alnum) + "." + some(22, alnum + "-_"), lambda: some(r.randint(20, 44), alnum), lambda: some(r.randint(24, 43), alnum + "+/") + "=", lambda: some(40, alnum + "/+"),
        lambda: some(r.randint(20, 40), lower), lambda: some(r.randint(20, 36), string.ascii_uppercase + string.digits), lambda: some(31, "0123456789abcdef"), lambda: some(24, "0123456789abcdef"), lambda: some(40, "0123456789ABCDEF"),
        lambda: some(r.randint(2, 4), string.ascii_letters) + r.choice(["", "", "_", "-"]) + some(r.choice([24, 32, 40]), "0123456789abcdef"),
    ])
    while True:
        out = make()
        if any(c.isdigit() for c in out) and any(c.isalpha() for c in out):
            return out


_PARTS = ("data", "main", "report", "image", "user", "index", "test", "build", "node", "mail", "server", "example", "table", "final", "draft", "photo", "chapter", "module", "north", "stream", "release", "config", "vector", "summer")


#: Frequent syllables, of which other words are made.
_SYLLABLES = (
    "ing er a ly ed i es re tion in e con y ter ex al de com o di en an ty ry u ti ri be per to pro ac ad ar ers ment or ble der ma na si un at dis ca cal man ap po sion vi el est la lar pa ture for is mer pe ra so "
    "ta as col fi ful ger low ni par son tle day ny pen pre tive car ci mo on ous pi se ten tor ver ber can dy et it mu no ple land light set some sub sur"
).split()


def _word(r: random.Random) -> str:
    return r.choice(_PARTS) if r.random() < 0.3 else "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def _lookalike(r: random.Random) -> str:
    p = lambda: _word(r)
    n = lambda a, b: str(r.randint(a, b))
    return r.choice([
        lambda: f"{p()}_{p()}_{n(1, 99)}.{r.choice(['csv', 'txt', 'png', 'py', 'html'])}", lambda: f"{p()}/{p()}/{p()}-{n(1, 999)}.{r.choice(['jpg', 'md', 'json'])}", lambda: f"{p()}{n(1, 9)}.{p()}.com", lambda: f"www.{p()}{n(1, 20)}.org/{p()}/{p()}",
        lambda: f"{p()}-{p()}-{n(1, 30)}.{n(0, 9)}.{n(0, 20)}", lambda: f"{n(1990, 2030)}-{n(1, 12)}-{n(1, 28)}T{n(10, 23)}-{n(10, 59)}-{n(10, 59)}Z", lambda: f"{p().upper()}-{p().upper()}-{n(1000, 99999)}", lambda: f"{p()}.{p()}.{p()}{n(1, 9)}.{p()}",
        lambda: f"{p()}{p().title()}{p().title()}{n(1, 99)}", lambda: f"{p()}_{p()}_{p()}_{n(1, 2000)}", lambda: f"{p()}.{p()}{n(1, 99)}.{p()}-{p()}", lambda: f"{p()}={n(1, 99)}/{p()}={n(1, 99)}/{p()}", lambda: "".join(p() for _ in range(4)) + n(1, 9),
        lambda: "-".join(p() for _ in range(r.randint(3, 8))) + "-" + n(1, 9999), lambda: "_".join(r.choice([p, p, p, lambda: n(1, 2030)])() for _ in range(r.randint(3, 9))) + n(1, 9), lambda: "/".join(p() for _ in range(r.randint(3, 8))) + f"{n(1, 40)}.{r.choice(['py', 'html', 'js', 'txt'])}",
        lambda: ".".join(p() for _ in range(r.randint(2, 4))) + "." + "".join(p().title() for _ in range(r.randint(2, 4))) + n(1, 9), lambda: f"{r.choice(['IMG', 'DSC', 'VID', 'scan'])}_{n(2000, 2030)}{n(10, 12)}{n(10, 28)}_{n(100000, 235959)}.{r.choice(['jpg', 'mp4', 'png'])}", lambda: f"{p()}-{n(1, 30)}.{n(0, 99)}.{n(0, 9)}-{r.choice(['rc', 'beta', 'alpha', 'live', 'amd'])}{n(1, 64)}.{r.choice(['iso', 'zip', 'whl', 'tgz'])}",
        lambda: f"{n(1, 20)}.{n(1000, 9999)}/{n(10, 999)}-{p()}-{p()}", lambda: f"{p()}/{n(1900, 2030)}/{n(1, 12)}/" + "-".join(p() for _ in range(r.randint(3, 8))) + ".html",
        lambda: f"{p()}{n(1, 99)}-{p()}{n(1, 99)}-{p()}", lambda: f"ISBN-{n(1000000000000, 9999999999999)}", lambda: f"{n(1, 99)}-{p()}-{n(1, 99)}-{p()}-{p()}",
    ])()


_FILL = ("the", "of", "and", "see", "run", "with", "for", "file", "in", "der", "la", "que", "when", "from", "to", "is", "by", "at")
#: What stands before keys and harmless runs alike.
_BEFORE = ("key ", "key=", "auth: ", "Authorization: Bearer ", "credential ", "access_key = \"", "client_id=", "use ", "--key ", "KEY='", "export X=", "see ", "file ", "at ", "path=", "version ", "in ", "from ", "import ", "open ", "id: ", "value ", "ref ", "\"", "(", "", "", "", "")


def _block(r: random.Random) -> str:
    some = lambda n: "".join(r.choice(string.ascii_letters + string.digits + "+/") for _ in range(n))
    kind = r.choice(["RSA ", "EC ", "OPENSSH ", ""])
    return "\n".join([f"-----BEGIN {kind}PRIVATE KEY-----", *[some(64) for _ in range(r.randint(1, 4))], some(r.randint(8, 60)) + "==", f"-----END {kind}PRIVATE KEY-----"])


def _login(r: random.Random, secret: bool) -> str:
    """User and password as in an address, or what stands for them in instructions."""
    some = lambda n: "".join(r.choice(string.ascii_letters + string.digits + "!$%_-") for _ in range(n))
    user = r.choice(["admin", "root", "app", "postgres", *_PARTS])
    return f"{user}:{some(r.randint(8, 24)) if secret else r.choice(['password', 'PASSWORD', 'pass', '<password>', '$PASSWORD', '{password}', '****', 'yourpassword', 'changeme'])}"


def _path(r: random.Random, own: str) -> str:
    """A long path or chain with a key or a look-alike somewhere in it."""
    steps = [r.choice([lambda: _word(r), lambda: _word(r), lambda: f"{_word(r)}{r.randint(1, 99)}", lambda: str(r.randint(1, 2030)), lambda: f"{_word(r)}-{_word(r)}", lambda: f"{_word(r)}={_word(r)}"])() for _ in range(r.randint(5, 18))]
    steps.insert(r.randint(0, len(steps)), r.choice(["", "", f"{r.choice(_PARTS)}="]) + own)
    return r.choice(["//", "/", ""]) + r.choice(["/", "/", "/", "."]).join(steps) + r.choice(["", "", ".html", ".json"])


def examples(count: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, Span, int]]:
    """(text, view of a candidate, 1 if a key is in it); views with a small piece of a key are left out."""
    r = random.Random(seed)
    out = []
    for _ in range(count):
        secret = r.random() < 0.5
        own = _key(r) if secret else _lookalike(r)
        shape = r.random()
        if shape < 0.05:
            own = _login(r, secret)
        elif shape < 0.1 and secret:
            own = _block(r)
        whole = f"{r.choice(['https', 'postgres', 'ftp', 'mysql'])}://{own}@{r.choice(_PARTS)}.example.com/{r.choice(_PARTS)}" if shape < 0.05 else _path(r, own) if shape >= 0.7 else own
        words = [r.choice(_FILL) for _ in range(r.randint(2, 12))]
        at = r.randint(0, len(words))
        before = r.choice(_BEFORE)
        text = " ".join(words[:at]) + " " + before + whole + r.choice(["", ".", "\"", "'", ",", "\n"]) + " " + " ".join(words[at:])
        least = min(LEAST, len(own))
        start = text.index(own, text.index(whole) + whole.index(own))
        for c in candidates(text):
            if own in text[c.start : c.end] or text[c.start : c.end] in own:
                for v in views(text, c):
                    common = min(v.end, start + len(own)) - max(v.start, start)
                    if not secret or common < 4 or common >= least:
                        out.append((text, v, int(secret and common >= least)))
    return out


class Model(NamedTuple):
    network: bytenet.Network
    #: Scores' log-odds to probability: slope and offset; the least probability of a secret.
    slope: float
    offset: float
    limit: float


def _probability(score: np.ndarray, slope: float, offset: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * _log_odds(score) + offset, -40, 40)))


def limit_of(p: np.ndarray, t: np.ndarray) -> float:
    """The least probability from EVEN on at which PRECISION of what is selected is right, but at most the one above
    which RECALL of the keys are, and two standard deviations of their number."""
    n = int(t.sum())
    missed = max(0, math.floor(n * (1 - RECALL) - 2 * math.sqrt(n * RECALL * (1 - RECALL))))
    recalled = float(np.sort(p[t == 1])[missed])
    order = np.argsort(-p, kind="stable")
    precise = np.flatnonzero(np.cumsum(t[order]) / np.arange(1, len(order) + 1) >= PRECISION)
    return min(recalled, max(EVEN, float(p[order[precise[-1]]]))) if len(precise) else recalled


@lru_cache(maxsize=1)
def trained() -> Model:
    made = examples()
    x, y = np.array([pictured(t, c) for t, c, _ in made]), np.array([v for *_, v in made])
    texts = {t: i for i, t in enumerate(dict.fromkeys(t for t, *_ in made))}
    of = np.array([texts[t] for t, *_ in made])
    part = of % 4  # 0 and 1: the network, 2: the curve, 3: the limit
    own = x[part < 2]
    network = bytenet.fit(lambda rows, rng: own[rows], y[part < 2], 2, WIDTHS, FILTERS, EPOCHS)
    # What follows goes by whole candidates: the likeliest view of each.
    score, t = np.zeros(len(texts)), np.zeros(len(texts), dtype=int)
    np.maximum.at(score, of[part > 1], bytenet.Scorer(network).probabilities(x[part > 1])[:, 1])
    np.maximum.at(t, of[part > 1], y[part > 1])
    slope, offset = _platt(_log_odds(score[2::4]), t[2::4])
    return Model(network, slope, offset, limit_of(_probability(score[3::4], slope, offset), t[3::4]))


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def _platt(z: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve from log-odds to probability, by Newton's steps."""
    slope, offset = 0.5, 0.0
    t = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))  # Platt's targets: clean examples don't drive the slope up
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(w * z * z).sum(), (w * z).sum()], [(w * z).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        slope, offset = np.array([slope, offset]) + np.linalg.solve(h, np.array([((t - p) * z).sum(), (t - p).sum()]))
    return float(slope), float(offset)


def finder(model: Model) -> Finder:
    scorer = bytenet.Scorer(model.network)

    def find(texts: list[str]) -> list[list[Span]]:
        fixed = [base_spans(t) for t in texts]
        proposed = [candidates(t) for t in texts]
        rows = [(i, c) for i, own in enumerate(proposed) for c in own]
        seen = [(k, v) for k, (i, c) in enumerate(rows) for v in views(texts[i], c)]
        best = np.zeros(len(rows))
        for at in range(0, len(seen), 512):
            part = seen[at : at + 512]
            np.maximum.at(best, [k for k, _ in part], scorer.probabilities(np.array([pictured(texts[rows[k][0]], v) for k, v in part]))[:, 1])
        good: list[list[Span]] = [[] for _ in texts]
        for (i, c), p in zip(rows, _probability(best, model.slope, model.offset)):
            if p >= model.limit:
                good[i].append(c._replace(probability=float(p)))
        return [f if not g else sorted([*f, *disjoint(f, g)], key=lambda s: (s.start, KINDS.index(s.kind))) for f, g in zip(fixed, good)]

    return find


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, spans) for each row, spans by start, then kind as in KINDS."""
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())
    return find_spans(docs, lambda: finder(shared.value))


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows with each secret in their text replaced by its kind in brackets."""
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())
    return spans.redact(docs, lambda: finder(shared.value))
