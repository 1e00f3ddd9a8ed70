"""Personal data beside other numbers."""

import random

import pytest

from candorlake.llm import pii


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("7536784127813050 4845168114407329", [("card", "7536784127813050"), ("card", "4845168114407329")]),
        ("paid 2353820953013749 4550997810720808 then", [("card", "4550997810720808")]),
        ("call +1 (826) 555-4081 190.137.223.204 now", [("ip", "190.137.223.204"), ("phone", "+1 (826) 555-4081")]),
        ("card 4111.1111.1111.1111 12/27 ok", [("card", "4111.1111.1111.1111")]),
        ("phone 555-123-4567 555-987-6543", [("phone", "555-123-4567"), ("phone", "555-987-6543")]),
    ],
)
def test_numbers_side_by_side(text, want):
    (got,) = pii.finder(pii.trained())([text])
    assert [(s.kind, text[s.start : s.end]) for s in got] == want


def test_parts_are_all_stretches_of_groups():
    r = random.Random(4)
    for _ in range(500):
        text = "".join(r.choice(["1", "42", "555", "4111", " ", "-", "(", "+", ".", "4111111111111111"]) for _ in range(r.randint(2, 20)))
        got = {s[:3] for m in pii._NUMBERS.finditer(text) for s in pii._parts(text, *m.span())}
        want = set()
        for m in pii._NUMBERS.finditer(text):
            groups = [g.span() for g in pii._GROUP.finditer(text, *m.span())]
            for i, (a, _) in enumerate(groups):
                while a > m.start() and text[a - 1] in "+(":
                    a -= 1
                for j, (_, b) in enumerate(groups[i:], i):
                    digits = "".join(c for c in text[a:b] if c.isdigit())
                    if (i, j) == (0, len(groups) - 1) or not 7 <= len(digits) <= 19:
                        continue
                    want |= {("card", a, b)} if len(digits) >= 12 and pii.luhn(digits) else set()
                    want |= {("phone", a, b)} if len(digits) <= 15 else set()
                    want |= {("ssn", a, b)} if len(digits) == 9 and b - a >= 11 else set()
        assert got == want, text
