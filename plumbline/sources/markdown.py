"""The Markdown mask: which characters of each line are prose, column for column.

Hidden: code blocks and spans, raw HTML, link and image targets, reference definitions, autolinks and bare addresses,
table pipes and rules, emphasis marks, front matter. Kept: everything a reader sees as text. This follows the public
CommonMark and GFM specifications; it is the only row-wise Python of the engine and runs on Markdown rows alone.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LINE = "array<struct<line:int,masked:string,kind:string,blank:boolean>>"
#: Front matter, read alike by Python and by Spark: a line of ---, and all up to the next line of --- or ...
FRONT_PATTERN = r"(?s)\A---\r?\n(?:.*?\n)??(?:---|\.\.\.)\r*(?:\n|\Z)"
FRONT = re.compile(FRONT_PATTERN)
FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
HEADING = re.compile(r"(#{1,6})(?=[ \t]|$)")
RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
ITEM = re.compile(r"([-+*]|\d{1,9}[.)])(?=[ \t]|$)")
SETEXT = re.compile(r"(=+|-+)[ \t]*$")
DELIMITER = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
DEFINITION = re.compile(r"\[(?:[^\[\]\\]|\\.)+\]:[ \t]*(?:<[^<>]*>|\S+)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")
#: HTML block openings and what closes each; None: a blank line.
HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:[ \t>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(
        r"</?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|"
        r"fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|"
        r"menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|"
        r"ul)(?:[ \t]|/?>|$)", re.I), None),
]
TAG = r"<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>"
WHOLE_TAG = re.compile(rf"(?:{TAG})[ \t]*$")
INLINE_HTML = re.compile(rf"{TAG}|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
AUTOLINK = re.compile(r"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+)>")
BARE = re.compile(r"(?:https?://|ftp://|www\.)[^\s<]+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
TARGET = re.compile(r"\(\s*(?:<[^<>\n]*>|[^\s()<>]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)", re.S)
PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


@dataclass
class Leaf:
    """Lines of one paragraph, heading or table row: (line, from, to) pieces."""

    kind: str
    pieces: list[tuple[int, int, int]]


def front_matter(text: str) -> int:
    """Where front matter ends, 0 if there is none."""
    m = FRONT.match(text)
    return m.end() if m else 0


def front_matter_end(text: Column) -> Column:
    """front_matter as an expression. Where Python's \\Z is the very end, Java's is \\z."""
    return F.length(F.regexp_extract(text, FRONT_PATTERN.replace(r"\Z", r"\z"), 0))


def leaves(lines: list[str], first: int) -> list[Leaf]:
    """The text-bearing blocks of lines[first:]."""
    out: list[Leaf] = []
    para: Leaf | None = None
    fence = html = None
    items: list[int] = []  # content columns of the open list items
    for n in range(first, len(lines)):
        line = lines[n]
        at = quotes = 0
        blank = not line.strip()
        indent = len(line) - len(line.lstrip(" "))
        if not blank:
            keep = [c for c in items if indent >= c]
            lazy = para is not None and len(keep) < len(items) and not ITEM.match(line, indent) and not HEADING.match(line, indent) and not FENCE.match(line[indent:])
            if not lazy:
                items = keep
            at = items[-1] if items and not lazy else 0
        while not blank and (m := re.compile(r" {0,3}> ?").match(line, at)):
            at, quotes = m.end(), quotes + 1
        rest = line[at:]
        if fence:
            mark, width = fence
            if re.fullmatch(rf" {{0,3}}{re.escape(mark)}{{{width},}}[ \t]*", rest):
                fence = None
            continue
        if html is not None:
            if (html and html.search(rest)) or (not html and blank):
                html = None
            continue
        while True:
            rest = line[at:]
            pad = len(rest) - len(rest.lstrip(" "))
            body = rest.lstrip(" \t")
            if not body:
                para = None
                break
            if pad >= 4 or rest.startswith("\t"):
                if para:
                    para.pieces.append((n, at + len(rest) - len(body), len(line)))
                break  # indented code
            here = at + pad
            if m := FENCE.match(body):
                fence, para = ((m[1] or m[3])[0], len(m[1] or m[3])), None
                break
            opened = next((close or "" for start, close in HTML if start.match(body)), None)
            if opened is None and para is None and WHOLE_TAG.match(body):
                opened = ""
            if opened is not None:
                para = None
                if not (opened and opened.search(body)):
                    html = opened
                break
            if m := HEADING.match(body):
                end = len(re.sub(r"(?:(?:^|[ \t]+)#+)?[ \t]*$", "", body[m.end() :])) + m.end()
                out.append(Leaf("heading", [(n, here + m.end(), here + end)]))
                para = None
                break
            if para and (m := SETEXT.match(body)) and not items[len(items) :]:
                para.kind, para = "heading", None
                break
            if RULE.match(body):
                para = None
                break
            if (m := ITEM.match(body)) and not (para and len(m[0]) > 1 and m[0][:-1] != "1" and not items) and not (para and not body[m.end() :].strip()):
                gap = len(body[m.end() :]) - len(body[m.end() :].lstrip(" "))
                at = here + m.end() + (gap if 1 <= gap <= 4 else 1)
                items, para = [*[c for c in items if c <= here], at], None
                continue
            if para is None and DEFINITION.match(body):
                break
            kind = "list" if items else "paragraph"
            if para and len(para.pieces) == 1 and DELIMITER.match(body) and ("|" in body or ":" in body) and body.count("-"):
                l0, a0, b0 = para.pieces[0]
                if cells(lines[l0], a0, b0) and len(cells(lines[l0], a0, b0)) == len(cells(line, here, len(line))):
                    out.remove(para)
                    out += [Leaf(kind, [(l0, a, b)]) for a, b in cells(lines[l0], a0, b0)]
                    para = Leaf("table", [])
                    break
            if para and para.kind == "table":
                out += [Leaf(kind, [(n, a, b)]) for a, b in cells(line, here, len(line))]
                break
            if para is None:
                para = Leaf(kind, [])
                out.append(para)
            para.pieces.append((n, here, len(line.rstrip())))
            break
    return out


def cells(line: str, start: int, end: int) -> list[tuple[int, int]]:
    """The cells of a table row, trimmed."""
    cuts = [i for i in range(start, end) if line[i] == "|" and (i == start or line[i - 1] != "\\")]
    if cuts and not line[start : cuts[0]].strip():
        start, cuts = cuts[0] + 1, cuts[1:]
    if cuts and not line[cuts[-1] + 1 : end].strip():
        end = cuts.pop()
    out = []
    for a, b in zip([start, *[c + 1 for c in cuts]], [*cuts, end], strict=True):
        piece = line[a:b]
        out.append((a + len(piece) - len(piece.lstrip()), a + len(piece.rstrip())))
    return out


def visible(text: str) -> list[bool]:
    """Which characters of a paragraph's text are prose."""
    show = [True] * len(text)

    def hide(a: int, b: int) -> None:
        show[a:b] = [False] * (b - a)

    marks: list[list] = []  # emphasis runs: [character, from, to, can open, can close]
    brackets: list[tuple[int, int]] = []  # (place, marks before)
    i = 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text) and text[i + 1] in PUNCTUATION:
            hide(i, i + 1)
            i += 2
        elif c == "`":
            run = re.compile("`+").match(text, i)[0]
            close = re.compile(rf"(?<!`){run}(?!`)").search(text, i + len(run))
            if close:
                hide(i, close.end())
                i = close.end()
            else:
                i += len(run)
        elif c == "<" and (m := AUTOLINK.match(text, i) or INLINE_HTML.match(text, i)):
            hide(i, m.end())
            i = m.end()
        elif c in "hfw" and (i == 0 or not text[i - 1].isalnum()) and (m := BARE.match(text, i)) and "@" not in m[0].split("/")[0]:
            end = m.end() - len(m[0]) + len(re.sub(r"[?!.,:*_~'\"]+$", "", m[0]))
            hide(i, end)
            i = max(end, i + 1)
        elif (c.isalnum() or c in "._+-") and (i == 0 or not (text[i - 1].isalnum() or text[i - 1] in "._+-")) and (m := re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+").match(text, i)):
            hide(i, m.end())
            i = m.end()
        elif c == "[" or (c == "!" and text[i + 1 : i + 2] == "["):
            brackets.append((i, len(marks)))
            i += 1 + (c == "!")
        elif c == "]" and brackets:
            start, _ = brackets.pop()
            m = TARGET.match(text, i + 1) or re.compile(r"\[(?:[^\[\]\\]|\\.)*\]").match(text, i + 1)
            if m:
                hide(start, start + 1 + (text[start] == "!"))
                hide(i, m.end())
                i = m.end()
            else:
                i += 1
        elif c in "*_~":
            run = re.compile(rf"\{c}+").match(text, i)[0]
            a, b = text[i - 1 : i] or " ", text[i + len(run) : i + len(run) + 1] or " "
            punct = lambda x: x in PUNCTUATION or unicodedata.category(x)[0] in "PS"
            left = not b.isspace() and (not punct(b) or a.isspace() or punct(a))
            right = not a.isspace() and (not punct(a) or b.isspace() or punct(b))
            opens, closes = (left and (not right or punct(a)), right and (not left or punct(b))) if c == "_" else (left, right)
            if c != "~" or len(run) <= 2:
                marks.append([c, i, i + len(run), opens, closes])
            i += len(run)
        else:
            i += 1
    for k, closer in enumerate(marks):
        for opener in reversed(marks[:k]):
            if not closer[4] or closer[1] >= closer[2]:
                break
            while opener[3] and opener[0] == closer[0] and opener[1] < opener[2] and closer[1] < closer[2]:
                n = min(2, opener[2] - opener[1], closer[2] - closer[1])
                if closer[0] == "~" and opener[2] - opener[1] != closer[2] - closer[1]:
                    break
                hide(opener[2] - n, opener[2])
                hide(closer[1], closer[1] + n)
                opener[2] -= n
                closer[1] += n
    return show


def mask_text(text: str) -> list[tuple[int, str, str, bool]]:
    """(line, masked, kind, blank) of every line."""
    lines = [s.removesuffix("\r") for s in text.split("\n")]
    hidden = text.count("\n", 0, front_matter(text)) if front_matter(text) < len(text) else len(lines)
    shown = [[" "] * len(s) for s in lines]
    kind, blank = ["paragraph"] * len(lines), [True] * len(lines)
    for leaf in leaves(lines, hidden):
        joined, places = [], []
        for n, a, b in leaf.pieces:
            joined.append(lines[n][a:b])
            places += [(n, c) for c in range(a, b)] + [(-1, -1)]
        for (n, c), keep in zip(places, [*visible("\n".join(joined)), False], strict=False):
            if n >= 0 and keep and (lines[n][c : c + 1].strip() or any(x != " " for x in lines[n][:c])):
                shown[n][c] = lines[n][c]
                blank[n] = False
                if leaf.kind in ("heading", "list"):
                    kind[n] = leaf.kind
    return [(n + 1, "".join(s), kind[n], blank[n]) for n, s in enumerate(shown)]


def mask(text: Column) -> Column:
    """The masked lines of a Markdown text; null gives null."""
    names = ("line", "masked", "kind", "blank")

    @F.pandas_udf(LINE)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [dict(zip(names, row, strict=True)) for row in mask_text(t)])

    return run(text)
