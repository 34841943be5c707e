"""The Markdown mask keeps columns and hides what is no prose."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.sources.markdown import front_matter, mask_text


@pytest.mark.parametrize(
    "text,want",
    [
        ("# Title here", [("  Title here", "heading", False)]),
        ("- Do the thing", [("  Do the thing", "list", False)]),
        ("1. Open the valve", [("   Open the valve", "list", False)]),
        ("#Title", [("#Title", "paragraph", False)]),
        ("```\nx\n```", [("   ", "paragraph", True), (" ", "paragraph", True), ("   ", "paragraph", True)]),
        ("see [link](http://x.y) now", [("see  link              now", "paragraph", False)]),
        ("a <b>c</b> `d` e", [("a    c         e", "paragraph", False)]),
        ("**bold** text", [("  bold   text", "paragraph", False)]),
    ],
)
def test_mask(text, want):
    assert [r[1:] for r in mask_text(text)] == want


def test_front_matter():
    assert front_matter("---\na: b\n---\nx") == 13
    assert front_matter("---\nnever") == 0


@settings(max_examples=200, deadline=None)
@given(st.text("ab #*_`[]()<>|-\n\\1.!~&;\t\r\"'/:", max_size=60))
def test_columns_stay(text):
    lines = [s.removesuffix("\r") for s in text.split("\n")]
    rows = mask_text(text)
    assert len(rows) == len(lines)
    for (n, masked, _, _), src in zip(rows, lines, strict=True):
        assert len(masked) == len(src) and all(m in (" ", s) for m, s in zip(masked, src, strict=True)), n
