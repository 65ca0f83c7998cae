"""Markdown as a table of blocks, and blocks rendered as markdown.

One pass over the lines of a text, with a stack of open quotes and list items,
gives a row for each leaf (paragraph, heading, fence, indented code, table, raw
HTML, rule) with the containers it lies in.  Everything after that is columns:
the marks of the containers before each line, the blank lines between blocks,
sections and their numbers.

One simplification: a tab goes to the next multiple of four of what is left of its
line after the marks of its containers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import inline
from ..functions import text as T

_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_UNDER = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}(?=[^`]*$)|~{3,})(.*)$")
_ITEM = re.compile(r"( {0,3})([-+*]|(\d{1,9})([.)]))(?=[ \t]|$)([ \t]*)(.*)$", re.S)
_DASHES = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
# Names of block elements and of elements with raw text.
_BLOCK_NAMES = "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h1|h2|h3|h4|h5|h6|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
_HTML = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile("-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf" {{0,3}}</?(?:{_BLOCK_NAMES})(?:\s|/?>|$)", re.I), None),
    (re.compile(r" {0,3}(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$"), None),
]


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _untabbed(line: str) -> str:
    """Leading tabs as spaces."""
    body = line.lstrip(" \t")
    return line[: len(line) - len(body)].expandtabs(4) + body if "\t" in line[: len(line) - len(body)] else line


def cells(line: str) -> list[str]:
    """Cells of a table row; a pipe after a backslash is part of its cell."""
    row = line.strip()
    parts = [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", row)]
    if row.startswith("|"):
        parts = parts[1:]
    return parts[:-1] if parts and row.endswith("|") and not row.endswith("\\|") else parts


class Fold:
    """Lines one after another; leaves in ``out`` as [path, kind, level, info, lines]."""

    def __init__(self):
        self.stack: list[dict] = []  # containers: quotes and items
        self.leaf: dict | None = None
        self.out: list[dict] = []
        self.links: dict[str, str] = {}
        self.made = 0

    def _close_leaf(self) -> None:
        leaf, self.leaf = self.leaf, None
        if leaf is None:
            return
        if leaf["kind"] == "paragraph":
            text = "\n".join(leaf["lines"])
            while m := inline.DEFINITION.match(text):
                self.links.setdefault(inline.label(m[1]), inline.address(m[2] if m[2] is not None else m[3]))
                text = text[m.end() :]
            leaf["lines"] = text.split("\n")
            if not text.strip():
                return
        elif leaf["kind"] in ("code", "html"):
            while leaf["lines"] and not leaf["lines"][-1].strip():
                leaf["lines"].pop()
        self.out.append(leaf)

    def _cut(self, depth: int) -> None:
        """Close containers below ``depth``, with the leaf; a container without a leaf gets an empty one."""
        if depth < len(self.stack):
            self._close_leaf()
            if not self.stack[-1]["full"]:
                self.out.append({"path": self._path(), "kind": "empty", "level": 0, "info": "", "lines": [""]})
                for c in self.stack:
                    c["full"] = True
            del self.stack[depth:]

    def _path(self, depth: int | None = None) -> list[dict]:
        path = []
        for c in self.stack[:depth]:
            path.append({"id": c["id"], "list": c.get("list"), "mark": c["mark"], "first": not c["full"] if c["kind"] == "item" else False})
        return path

    def _open(self, kind: str, line: str, level: int = 0, info: str = "", **more) -> None:
        self._close_leaf()
        self.leaf = {"path": self._path(), "kind": kind, "level": level, "info": info, "lines": [line], **more}
        for c in self.stack:
            c["full"] = True

    def _push(self, kind: str, mark: str, **more) -> None:
        self.made += 1
        self.stack.append({"kind": kind, "id": self.made, "mark": mark, "full": False, **more})

    def _matched(self, line: str) -> tuple[int, str]:
        """How many containers go on with this line, and what is left of it."""
        for k, c in enumerate(self.stack):
            if c["kind"] == "quote":
                if _indent(line) > 3 or not line.lstrip(" ").startswith(">"):
                    return k, line
                line = _untabbed(line.lstrip(" ")[1:])
                line = line[1:] if line.startswith(" ") else line
            elif not line.strip():
                c["spent"] = True
            elif not c["full"] and c.get("spent"):  # an item that starts with an empty line ends with the next one
                return k, line
            elif _indent(line) >= c["indent"]:
                line = _untabbed(line[c["indent"] :])
            else:
                return k, line
        return len(self.stack), line

    def _starts_leaf(self, line: str, in_paragraph: bool) -> bool:
        return bool(_ATX.match(line) or _FENCE.match(line) or _RULE.match(line) or any(a.match(line) for a, _ in _HTML[: 6 if in_paragraph else 7]))

    def feed(self, line: str) -> None:
        line = _untabbed(line)
        depth, rest = self._matched(line)
        whole = depth == len(self.stack)
        leaf = self.leaf
        if leaf is not None and leaf["kind"] in ("fence", "html") and whole:
            self._raw(rest)
            return
        opened = False
        while rest.strip() and _indent(rest) < 4:
            in_paragraph = self.leaf is not None and self.leaf["kind"] == "paragraph"
            if rest.lstrip(" ").startswith(">"):
                self._cut(depth)
                self._close_leaf()
                self._push("quote", "> ")
                rest = _untabbed(rest.lstrip(" ")[1:])
                rest = rest[1:] if rest.startswith(" ") else rest
            else:
                m = _ITEM.match(rest)
                under = whole and in_paragraph and not opened and _UNDER.match(rest)
                if not m or _RULE.match(rest) or under:
                    break
                if in_paragraph and whole and not opened and (not m[6].strip() or m[3] and m[3] != "1"):
                    break
                kind = m[4] or m[2]
                last = self.stack[depth] if depth < len(self.stack) else None
                same = last is not None and last["kind"] == "item" and last["type"] == kind
                self._cut(depth)
                self._close_leaf()
                number = last["number"] + 1 if same and m[3] else int(m[3] or 0)
                mark = f"{number}{kind} " if m[3] else f"{kind} "
                gap = (" " * m.end(2) + m[5]).expandtabs(4)[m.end(2) :]
                spaces = len(gap) if m[6].strip() and len(gap) <= 4 else 1
                self.made += 1
                owner = last["list"] if same else self.made
                self._push("item", mark, indent=len(m[1]) + len(m[2]) + spaces, type=kind, list=owner, number=number)
                rest = gap[spaces:] + m[6]
            depth, opened, whole = len(self.stack), True, True
        self._leaf_line(rest, depth, whole)

    def _leaf_line(self, rest: str, depth: int, whole: bool) -> None:
        leaf = self.leaf
        if not rest.strip():
            self._cut(depth)
            if self.leaf is not None and self.leaf["kind"] == "code":
                self.leaf["lines"].append(rest[4:])
            elif self.leaf is not None:
                self._close_leaf()
            return
        in_paragraph = leaf is not None and leaf["kind"] == "paragraph"
        deep = _indent(rest) >= 4
        if in_paragraph and not whole and (deep or not self._starts_leaf(rest, True)):
            leaf["lines"].append(rest.lstrip(" "))
            return
        self._cut(depth)
        leaf = self.leaf
        in_paragraph = leaf is not None and leaf["kind"] == "paragraph"
        if deep and not in_paragraph:
            if leaf is not None and leaf["kind"] == "code":
                leaf["lines"].append(rest[4:])
            else:
                self._open("code", rest[4:])
            return
        if in_paragraph and not deep:
            m = _UNDER.match(rest)
            if m and "\n".join(leaf["lines"]).strip():
                leaf["kind"], leaf["level"] = "heading", 1 if m[1][0] == "=" else 2
                self._close_leaf()
                return
            head = cells(leaf["lines"][-1])
            if _DASHES.match(rest) and ("|" in rest or ":" in rest or len(head) == 1) and "|" in leaf["lines"][-1] + rest and len(head) == len(cells(rest)):
                path, first = leaf["path"], leaf["lines"].pop()
                if leaf["lines"]:
                    self._close_leaf()
                    path = self._path()
                self.leaf = {"path": path, "kind": "table", "level": 0, "info": "", "lines": [first, rest]}
                return
        if leaf is not None and leaf["kind"] == "table":
            if not deep and not self._starts_leaf(rest, True):
                leaf["lines"].append(rest)
                return
            self._close_leaf()
        if not deep and self._starts(rest, in_paragraph):
            return
        if in_paragraph:
            leaf["lines"].append(rest.lstrip(" \t"))
        else:
            self._open("paragraph", rest.lstrip(" \t"))

    def _starts(self, rest: str, in_paragraph: bool) -> bool:
        """Whether the line starts a leaf of another kind."""
        if m := _ATX.match(rest):
            text = (m[2] or "").strip()
            self._open("heading", "" if text.strip("#") == "" and text else text, len(m[1]))
            self._close_leaf()
        elif m := _FENCE.match(rest):
            self._open("fence", "", info=f"{m[2]}\n{inline.unescaped(m[3].strip())}", fence=m[2], indent=len(m[1]))
            self.leaf["lines"].clear()
        elif m := _RULE.match(rest):
            self._open("rule", m[1] * 3)
            self._close_leaf()
        else:
            for k, (start, end) in enumerate(_HTML[: 6 if in_paragraph else 7]):
                if start.match(rest):
                    self._open("html", rest, end=end)
                    if end is not None and end.search(rest):
                        self._close_leaf()
                    return True
            return False
        return True

    def _raw(self, rest: str) -> None:
        leaf = self.leaf
        if leaf["kind"] == "fence":
            mark = rest.strip()
            if _indent(rest) < 4 and mark and len(mark) >= len(leaf["fence"]) and not mark.strip(leaf["fence"][0]):
                self._close_leaf()
            else:
                leaf["lines"].append(rest[min(leaf["indent"], _indent(rest)) :])
        elif leaf["end"] is None and not rest.strip():
            self._close_leaf()
        else:
            leaf["lines"].append(rest)
            if leaf["end"] is not None and leaf["end"].search(rest):
                self._close_leaf()

    def done(self) -> list[dict]:
        self._cut(0)
        self._close_leaf()
        return self.out


def _shown(text: str, links: dict[str, str]) -> str:
    return inline.rendered(inline.tokens_of(text, links)).strip()


def _table(lines: list[str], links: dict[str, str]) -> str:
    head = cells(lines[0])
    sides = [("left" if c.startswith(":") else "") + ("right" if c.endswith(":") else "") for c in cells(lines[1])]
    marks = [{"": "---", "left": ":---", "right": "---:", "leftright": ":---:"}[s] for s in sides]
    rows = [(cells(x) + [""] * len(head))[: len(head)] for x in lines[2:]]
    row = lambda parts: "| " + " | ".join(parts) + " |"
    shown = lambda parts: row([_shown(c, links).replace("\\", "\\\\").replace("|", "\\|") for c in parts])
    return "\n".join([shown(head), row(marks), *map(shown, rows)])


def leaf_text(leaf: dict, links: dict[str, str]) -> str:
    """A leaf as markdown, without the marks of its containers; a heading without its own."""
    kind, lines = leaf["kind"], leaf["lines"]
    if kind in ("paragraph", "heading"):
        return _shown("\n".join(lines), links)
    if kind == "table":
        return _table(lines, links)
    if kind == "fence":
        mark, info = leaf["info"].split("\n", 1)
        body = "\n".join(lines).rstrip("\n")
        return "\n".join([mark + info, *([body] if body else []), mark])
    if kind == "code":
        return "\n".join(f"    {x}" if x else "" for x in lines)
    return "\n".join(lines)


PATH = "array<struct<id:int,list:int,mark:string,first:boolean>>"
_PATH = pa.list_(pa.struct([("id", pa.int32()), ("list", pa.int32()), ("mark", pa.string()), ("first", pa.bool_())]))
LEAF = [("at", pa.int32()), ("path", _PATH), ("kind", pa.string()), ("level", pa.int32()), ("text", pa.string())]


SLICE = 1 << 18  # bytes of text that are lists of Python objects at a time, about


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``SLICE`` bytes of the last column at most (one row at least), since what is made of a text is many times its size."""
    for batch in batches:
        start = held = 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist()):
            if i > start and held + size > SLICE:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def blocks(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, at, path, kind, level, text: the leaves of markdown texts in order (null: none).

    ``path`` has the containers from the outside in: an id, the id of the list
    of an item, the mark (``> ``, ``- ``, ``3. ``) and whether the leaf is the
    first of its item.  Items of a list are numbered on from its first one.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    held = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], T.unix_newlines(F.col(text)).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows, origin = [], []
            for i, md in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                fold = Fold()
                for line in (md or "").split("\n"):
                    fold.feed(line)
                for at, leaf in enumerate(fold.done()):
                    rows.append((at, leaf["path"], leaf["kind"], leaf["level"], leaf_text(leaf, fold.links)))
                    origin.append(i)
            mine = [c.take(pa.array(origin, pa.int64())) for c in batch.columns[:-1]]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in LEAF]
            yield pa.RecordBatch.from_arrays([*mine, *[pa.array(c, t) for c, (_, t) in zip(cols, LEAF, strict=True)]], names=[*names, *[n for n, _ in LEAF]])

    kinds = ", ".join(f"{n} {held.schema[n].dataType.simpleString()}" for n in names)
    out = held.mapInArrow(run, f"{kinds}, at int, path {PATH}, kind string, level int, text string")
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "at", "path", "kind", "level", "text")


def _marks(path: Column, first: bool) -> Column:
    """What stands before the first line of a leaf, or before the others."""
    space = lambda c: F.repeat(F.lit(" "), F.length(c["mark"]))
    one = lambda c: F.when(c["list"].isNull() | (c["first"] if first else F.lit(False)), c["mark"]).otherwise(space(c))
    return F.array_join(F.transform(path, one), "")


def marked(path: Column, text: Column) -> Column:
    """The lines of a leaf with the marks of its containers; an empty line has no trailing spaces."""
    line = lambda x, i: F.when(i == 0, F.concat(_marks(path, True), x)).otherwise(F.concat(_marks(path, False), x))
    return F.array_join(F.transform(F.split(text, "\n"), lambda x, i: F.when(x == "", F.rtrim(line(x, i))).otherwise(line(x, i))), "\n")


def parted(before: Column, path: Column) -> Column:
    """What stands between a leaf and the one before it: one newline between items of a list, else a blank line in what both lie in."""
    n = F.least(F.size(before), F.size(path))
    same = F.coalesce(F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(before, i)["id"] == F.get(path, i)["id"])), F.lit(0))
    shared = F.when(n > 0, same).otherwise(0)
    a, b = F.get(before, shared), F.get(path, shared)
    blank = F.rtrim(_marks(F.slice(path, 1, shared), False))
    return F.when(a["list"] == b["list"], F.lit("\n")).otherwise(F.concat(F.lit("\n"), blank, F.lit("\n")))


def rendered(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """keys, content: the leaves of each key put together again, normalized; keys whose leaves are all empty have an empty text."""
    own = F.when(F.col("kind") == "heading", F.rtrim(F.concat(T.heading_mark(F.col("level")), F.lit(" "), F.col("text")))).otherwise(F.col("text"))
    shown = leaves.withColumn("_own", marked(F.col("path"), own)).where((F.col("_own") != "") | (F.size("path") > 0))
    before = F.lag("path").over(Window.partitionBy(*keys).orderBy("at"))
    pieces = shown.withColumn("_piece", F.concat(F.when(before.isNull(), "").otherwise(parted(before, F.col("path"))), F.col("_own")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "_piece"))), lambda x: x["_piece"]), "")
    return pieces.groupBy(*keys).agg(T.strip(whole).alias("content"))


def inline_tokens(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, pos, type, content: inline tokens of runs of markdown (null: none), without definitions of links."""
    names = [f"_k{i}" for i in range(len(keys))]
    held = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], T.unix_newlines(F.col(text)).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = [(i, pos, *t) for i, md in enumerate(batch.column(batch.num_columns - 1).to_pylist()) for pos, t in enumerate(inline.tokens_of(md or "", {}))]
            origin, *cols = zip(*rows, strict=True) if rows else ([], [], [], [])
            mine = [c.take(pa.array(origin, pa.int64())) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*mine, *[pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.string()), strict=True)]], names=[*names, "pos", "type", "content"])

    kinds = ", ".join(f"{n} {held.schema[n].dataType.simpleString()}" for n in names)
    out = held.mapInArrow(run, f"{kinds}, pos int, type string, content string")
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "pos", "type", "content")


def inline_text(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text, problem: tables of inline tokens (keys, pos, type, content) as markdown.

    An opening token and its closing one get the same mark, a link its address at
    the end.  Where tokens do not nest the text is null and ``problem`` says why.
    """
    from ..operators import nesting

    marks = F.create_map(*[F.lit(x) for name, mark in inline.MARKS.items() for x in (name, mark)])
    links = nesting.pairs(tokens, keys).where("name = 'link'").select(*keys, F.col("open_pos").alias("_open"), F.col("close_pos").alias("pos"))
    targets = links.join(tokens.select(*keys, F.col("pos").alias("_open"), F.col("content").alias("_href")), [*keys, "_open"]).drop("_open")
    kind, content = F.col("type"), F.col("content")
    alone = F.when(kind == "softbreak", "\n").when(kind == "hardbreak", "  \n").when(kind == "code_inline", F.concat(F.lit("`"), content, F.lit("`")))
    alone = alone.when(kind == "image", F.concat(F.lit("!["), F.regexp_replace(content, r"\n[^\n]*\z", ""), F.lit("]("), F.regexp_extract(content, r"([^\n]*)\z", 1), F.lit(")")))
    alone = alone.when(kind == "link_open", "[").when(kind == "link_close", F.concat(F.lit("]("), "_href", F.lit(")"))).when(kind.isin("text", "html_inline"), content)
    piece = alone.otherwise(F.try_element_at(marks, F.regexp_replace(kind, "_(open|close)$", "")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", piece.alias("p")))), lambda x: x["p"]), "")
    texts = tokens.join(targets, [*keys, "pos"], "left").groupBy(*keys).agg(T.strip(whole).alias("text"))
    wrong = nesting.problems(tokens, keys).select(*keys, "problem")
    return texts.join(wrong, keys, "left").select(*keys, F.when(F.col("problem").isNull(), F.col("text")).alias("text"), "problem")


def sections(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, pos, heading, level, content: the sections of markdown texts, in order.

    A heading that lies in no quote or list starts a section.  What stands
    before the first one is the Introduction, of level 1.  Sections without
    content are left out; a heading without text is "Untitled Section n", n being
    one more than the sections kept before it.
    """
    w = Window.partitionBy(*keys).orderBy("at")
    top = (F.col("kind") == "heading") & (F.size("path") == 0)
    s = blocks(df, keys, text).withColumn("_top", top).withColumn("section", F.sum(top.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    by = [*keys, "section"]
    before = F.lag(F.when(F.col("_top"), None).otherwise(F.col("path"))).over(w)
    own = F.when(F.col("kind") == "heading", F.rtrim(F.concat(T.heading_mark(F.col("level")), F.lit(" "), F.col("text")))).otherwise(F.col("text"))
    s = s.withColumn("_before", before).withColumn("_own", marked(F.col("path"), own))
    piece = F.when(F.col("_top") | (F.col("_own") == "") & (F.size("path") == 0), None).otherwise(F.concat(F.when(F.col("_before").isNull(), "").otherwise(parted(F.col("_before"), F.col("path"))), F.col("_own")))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(piece.isNotNull(), F.struct("at", piece.alias("p"))))), lambda x: x["p"]), "")
    out = s.groupBy(*by).agg(F.max(F.when(F.col("_top"), F.col("level"))).alias("level"), F.max(F.when(F.col("_top"), F.col("text"))).alias("heading"), T.strip(content).alias("content"))
    order = Window.partitionBy(*keys).orderBy("section")
    kept = F.coalesce(F.sum((F.col("content") != "").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heading = F.when(F.col("section") == 0, "Introduction").when(F.coalesce("heading", F.lit("")) == "", F.format_string("Untitled Section %d", kept + 1)).otherwise(F.col("heading"))
    full = out.withColumns({"heading": heading, "level": F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), "pos": (kept + 1).cast("int")})
    return full.where("content != ''").select(*keys, "pos", "heading", "level", "content")
