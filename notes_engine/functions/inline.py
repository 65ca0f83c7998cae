"""Inline markdown as tokens: a helper for one run of text, used inside Arrow batches.

A token is (type, content).  Types that end with ``_open`` and ``_close`` come in
pairs; the content of ``link_open`` is its address.
"""

from __future__ import annotations

import html
import re
import unicodedata
from urllib.parse import quote

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.\-]{1,31}:[^<>\x00-\x20]*)>")
_MAIL = re.compile(r"<([\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>")
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
_TITLE = r"(?:\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\))"
_TARGET = re.compile(r"\(\s*(?:<((?:\\.|[^<>\\\n])*)>|((?:\\.|[^\s()\\]|\((?:\\.|[^\s()\\])*\))*))(?:\s+" + _TITLE + r")?\s*\)", re.S)
DEFINITION = re.compile(r" {0,3}\[((?:\\.|[^\[\]\\])+)\]:[ \t]*\n?[ \t]*(?:<((?:\\.|[^<>\\\n])*)>|(\S+))(?:[ \t]*(?:\n[ \t]*|[ \t])" + _TITLE + r")?[ \t]*(?:\n|\Z)")
_PLAIN = re.compile(r"[^\\`*_~\[\]!<&\n]+")
_TICKS, _DELIMITERS = re.compile("`+"), re.compile(r"\*+|_+|~+")
_LABEL = re.compile(r"\[((?:\\.|[^\[\]\\])*)\]")
_STYLES = {1: "em", 2: "strong"}
MARKS = {"em": "*", "strong": "**", "s": "~~"}


def unescaped(text: str) -> str:
    """Without backslashes before punctuation; entities as characters."""
    return re.sub(r"\\([" + re.escape(PUNCTUATION) + r"])|" + _ENTITY.pattern, lambda m: m[1] or html.unescape(m[0]), text)


def address(raw: str) -> str:
    return quote(unescaped(raw), safe="%" + "/:?#[]@!$&'()*+,;=~-._")


def label(raw: str) -> str:
    return re.sub(r"\s+", " ", raw.strip()).casefold()


def _blank(c: str) -> bool:
    return not c or c.isspace()


def _mark(c: str) -> bool:
    return bool(c) and (c in PUNCTUATION or unicodedata.category(c)[0] in "PS")


class _Run:
    """A run of delimiters: how many are left, and whether it can open or close."""

    def __init__(self, at: int, c: str, n: int, before: str, after: str):
        self.at, self.c, self.n, self.whole = at, c, n, n
        left = not _blank(after) and (not _mark(after) or _blank(before) or _mark(before))
        right = not _blank(before) and (not _mark(before) or _blank(after) or _mark(after))
        self.opens = left and (c != "_" or not right or _mark(before))
        self.closes = right and (c != "_" or not left or _mark(after))


def _paired(tokens: list[list], runs: list[_Run]) -> None:
    """Turn runs of delimiters into opening and closing tokens; tokens are [before, own, after] lists of tokens."""
    k, lowest = 0, {}  # below ``lowest`` a kind of closing run has found nothing before
    while k < len(runs):
        closer = runs[k]
        if not closer.closes or closer.n == 0 or closer.c == "~" and closer.n < 2:
            k += 1
            continue
        sort = (closer.c, closer.opens, closer.whole % 3)
        for j in range(k - 1, lowest.get(sort, 0) - 1, -1):
            opener = runs[j]
            if opener.c != closer.c or not opener.opens or not opener.n or closer.c == "~" and opener.n < 2:
                continue
            both = (opener.closes or closer.opens) and (opener.whole + closer.whole) % 3 == 0 and (opener.whole % 3 or closer.whole % 3)
            if closer.c != "~" and both:
                continue
            size = 2 if opener.n >= 2 and closer.n >= 2 else 1
            name = "s" if closer.c == "~" else _STYLES[size]
            tokens[opener.at][2].insert(0, (f"{name}_open", ""))
            tokens[closer.at][0].append((f"{name}_close", ""))
            opener.n, closer.n = opener.n - size, closer.n - size
            for between in runs[j + 1 : k]:
                between.opens = between.closes = False
            break
        else:
            lowest[sort] = k
            k += 1
    for run in runs:
        if run.n:
            tokens[run.at][1].append(("text", run.c * run.n))
    runs.clear()


def tokens_of(text: str, links: dict[str, str]) -> list[tuple[str, str]]:
    """Tokens of a text; ``links``: addresses by label."""
    out: list[list] = []  # of [before, own, after]
    runs: list[_Run] = []
    brackets: list[list] = []  # [place in out, place in text, image, active, runs before]

    def put(kind: str, content: str = "") -> None:
        out.append([[], [(kind, content)], []])

    unended: set[int] = set()  # sizes of runs of backticks that nothing ends any more
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        m = _PLAIN.match(text, i)
        if m:
            put("text", m[0])
            i = m.end()
        elif c == "\n":
            spaces = 0
            if out and out[-1][1] and out[-1][1][-1][0] == "text":
                before = out[-1][1][-1][1]
                spaces = len(before) - len(before.rstrip(" "))
                out[-1][1][-1] = ("text", before.rstrip(" "))
            put("hardbreak" if spaces >= 2 else "softbreak")
            i += 1
            while i < n and text[i] in " \t":
                i += 1
        elif c == "\\":
            after = text[i + 1 : i + 2]
            if after == "\n":
                put("hardbreak")
                i += 2
                while i < n and text[i] in " \t":
                    i += 1
            else:
                put("text", after if after and after in PUNCTUATION else c)
                i += 2 if after and after in PUNCTUATION else 1
        elif c == "`":
            size = _TICKS.match(text, i).end() - i
            end = None if size in unended else re.compile(rf"(?<!`)`{{{size}}}(?!`)").search(text, i + size)
            if end:
                code = text[i + size : end.start()].replace("\n", " ")
                put("code_inline", code[1:-1] if code.strip() and code[0] == code[-1] == " " else code)
                i = end.end()
            else:
                unended.add(size)
                put("text", "`" * size)
                i += size
        elif c in "*_~":
            size = _DELIMITERS.match(text, i).end() - i
            runs.append(_Run(len(out), c, size, text[i - 1 : i], text[i + size : i + size + 1]))
            out.append([[], [], []])
            i += size
        elif c == "[" or c == "!" and text[i + 1 : i + 2] == "[":
            size = 1 if c == "[" else 2
            brackets.append([len(out), i + size, size == 2, True, len(runs)])
            put("text", text[i : i + size])
            i += size
        elif c == "]":
            i = _closed(text, i, out, runs, brackets, links, put)
        elif c == "<" and (m := _AUTOLINK.match(text, i) or _MAIL.match(text, i)):
            put("link_open", quote(m[1] if m.re is _AUTOLINK else f"mailto:{m[1]}", safe="%/:?#[]@!$&'()*+,;=~-._"))
            put("text", m[1])
            put("link_close")
            i = m.end()
        elif c == "<" and (m := _TAG.match(text, i)):
            put("html_inline", m[0])
            i = m.end()
        elif c == "&" and (m := _ENTITY.match(text, i)):
            put("text", html.unescape(m[0]))
            i = m.end()
        else:
            put("text", c)
            i += 1
    _paired(out, runs)
    return [t for part in out for side in part for t in side]


def _closed(text: str, i: int, out: list, runs: list, brackets: list, links: dict, put) -> int:
    """What a closing bracket at ``i`` ends; the place after it."""
    if not brackets:
        put("text", "]")
        return i + 1
    at, start, image, active, before = brackets.pop()
    inside = text[start:i]
    m, target = _TARGET.match(text, i + 1), None
    if m:
        target, end = address(m[1] if m[1] is not None else m[2] or ""), m.end()
    else:
        named = _LABEL.match(text, i + 1)
        target = links.get(label(named[1] or inside if named else inside))
        end = named.end() if named else i + 1
        if target is None and named and named[1]:  # the label is not known: brackets of another kind
            end = i + 1
    if not active or target is None:
        put("text", "]")
        return i + 1
    if image:
        del out[at:], runs[before:]
        put("image", f"{inside}\n{target}")
        return end
    out[at] = [[], [("link_open", target)], []]
    own = runs[before:]
    del runs[before:]
    _paired(out, own)
    put("link_close")
    for b in brackets:
        b[3] = b[3] and b[2]  # no link within a link
    return end


def rendered(tokens: list[tuple[str, str]]) -> str:
    """Tokens as markdown; each closing token gets the mark of the open one."""
    out, open_ = [], []
    for kind, content in tokens:
        if kind in ("text", "html_inline"):
            out.append(content)
        elif kind == "softbreak":
            out.append("\n")
        elif kind == "hardbreak":
            out.append("  \n")
        elif kind == "code_inline":
            out.append(f"`{content}`")
        elif kind == "image":
            alt, _, src = content.rpartition("\n")
            out.append(f"![{alt}]({src})")
        elif kind == "link_open":
            open_.append(content)
            out.append("[")
        elif kind == "link_close":
            out.append(f"]({open_.pop()})")
        else:
            out.append(MARKS[kind.rpartition("_")[0]])
    return "".join(out)
