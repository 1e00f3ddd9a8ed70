"""Keys in the middle of long runs."""

import pytest

from candorlake.llm import secretscan
from candorlake.llm.spans import Span

KEY = "aB3dE5fG7hI9jK1lM3nO5pQ7rS9tU1vW3xY5zA7b"


@pytest.mark.parametrize("run", [f"//api.example.com/v1/accounts/{KEY}/invoices/2024/list.html", f"/data/main/report/2024/user/{KEY}/table/final/draft/chapter7/index", f"node=main/user=north/stream=vector/{KEY}/release=final/config=summer2"])
def test_key_inside_a_long_run(run):
    find = secretscan.finder(secretscan.trained())
    text = f"see {run} now"
    (got,) = find([text])
    assert any(s.kind == "key" and KEY in text[s.start : s.end] for s in got)
    assert find([text.replace(KEY, "north/stream/table/final")]) == [[]]


def test_views_show_every_character():
    for n in range(1, 400):
        text = ("ab1/cd2=" * 60)[:n]
        seen = secretscan.views(text, Span("key", 0, n, False))
        assert all(v.end - v.start <= secretscan.OWN for v in seen)
        assert {i for v in seen for i in range(v.start, v.end)} == set(range(n))
