"""Repair of the turns of conversations by a dynamic program over a prefix trie.

1. Each row gets its first fault (blank, duplicate, truncated) and its role's
   initial, one letter for both.  The letters of a conversation in order are its
   signature; rows travel here without their texts.
2. Distinct signatures are dealt out by range and sorted, so that each task walks
   a prefix trie of its own depth first: what two neighbours share was computed
   for the first one.  A node holds a layer: for each state of the target
   ``(s?(ua)+)?`` the least cost and the rank of the least of its edit strings.
   A terminal node gives the answer of a signature.
3. Answers go back to their conversations and meet the rows once more, in order,
   in a stream that applies the edits.

A layer's edit strings end with an edit of the same row, so none of them is the
start of another, and their order does not change when they grow: ranks among
four states are enough, and no string is built before a terminal node.

A conversation is never gathered: both passes stream over sorted rows.  What grows
with the longest conversation is its signature and edit string, a byte for a row,
which the answer holds as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_bounded, stored, tidied

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
RULED = 20  # remainders of the damage
RETYPE, DELETE, INSERT, OPEN_END = 2, 3, 2, 1  # costs of edits, and of a truncated row that stays

#: States of the target: nothing yet, after the system row, after a user's, after an assistant's.
NONE, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
MADE = {NONE: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}  # by a retyped or inserted row
NAMED = {USER: "user", ASSISTANT: "assistant"}
FINAL = (NONE, ASSISTANT)
#: An insert leads from one of the last two states to the other, and what the first two can do from here on, an
#: assistant's can for one deletion (of the system row) more.  So a state that costs more than both together over the
#: best one is on no best path, not even on an equal one; without such states distinct layers are few.
FARTHEST = INSERT + DELETE

Layer = tuple  # for each state: None, or (cost above the layer's least, rank)
START: Layer = ((0, 0), None, None, None)


def _inserted(state: int, most: int = 2) -> Iterator[tuple[int, int]]:
    """(how many, state) after inserts; after more than two a cheaper way to the same state exists."""
    for k in range(most + 1):
        yield k, state
        state = MADE[state]


class Layers:
    """Steps from layer to layer; each distinct one is worked out once."""

    def __init__(self):
        self.known: dict[tuple[Layer, str], tuple[Layer, int, tuple]] = {}

    def step(self, layer: Layer, letter: str) -> tuple[Layer, int, tuple]:
        """The next layer, what its least cost adds, and for each of its states (state before, edits)."""
        got = self.known.get((layer, letter))
        if got is None:
            got = self.known[layer, letter] = self._worked_out(layer, letter)
        return got

    @staticmethod
    def _worked_out(layer: Layer, letter: str) -> tuple[Layer, int, tuple]:
        best: dict[int, tuple] = {}  # state: cost, rank before, edits, state before
        kind, stays = letter.lower(), OPEN_END if letter.isupper() else 0
        for before, entry in enumerate(layer):
            if entry is None:
                continue
            for k, at in _inserted(before):
                ways = [(DELETE, "D", at)]
                if letter != "-":
                    ways.append((RETYPE + stays, "R", MADE[at]))
                    if at in KEPT.get(kind, ()):
                        ways.append((stays, "K", KEPT[kind][at]))
                for cost, edit, after in ways:
                    found = (entry[0] + INSERT * k + cost, entry[1], "I" * k + edit, before)
                    if after not in best or found < best[after]:
                        best[after] = found
        least = min(x[0] for x in best.values())
        best = {s: x for s, x in best.items() if x[0] - least <= FARTHEST}
        order = {s: r for r, s in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
        states = range(len(layer))
        after = tuple((best[s][0] - least, order[s]) if s in best else None for s in states)
        return after, least, tuple((best[s][3], best[s][2]) if s in best else None for s in states)

    @staticmethod
    def ended(layer: Layer) -> tuple[int, int, str]:
        """Added cost, last state and trailing inserts of the best end."""
        cost, _, edits, state = min(
            (entry[0] + INSERT * k, entry[1], "I" * k, before) for before, entry in enumerate(layer) if entry is not None for k, at in _inserted(before) if at in FINAL
        )
        return cost, state, edits


def shared_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # the first `low` letters are equal, the first `high` are not
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


class Trie:
    """The path from the root to the signature put in last, with a layer at each node.

    Signatures come sorted, so a node that is left is never entered again and
    need not be kept.
    """

    def __init__(self):
        self.layers, self.last = Layers(), ""
        self.path: list[tuple[Layer, int]] = [(START, 0)]  # and the cost so far
        self.back: list[tuple] = []

    def answer(self, signature: str) -> tuple[int, str]:
        """Cost and edits of a signature."""
        shared = shared_prefix(self.last, signature)
        del self.path[shared + 1 :], self.back[shared:]
        layer, cost = self.path[-1]
        for letter in signature[shared:]:
            layer, more, back = self.layers.step(layer, letter)
            cost += more
            self.path.append((layer, cost))
            self.back.append(back)
        self.last = signature
        more, state, edits = self.layers.ended(layer)
        parts = [edits]
        for back in reversed(self.back):
            state, edits = back[state]
            parts.append(edits)
        return cost + more, "".join(reversed(parts))


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = Trie()
    for batch in batches:
        signatures = batch.column(0).to_pylist()
        found = [trie.answer(s) for s in signatures]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["signature", "cost", "audit"])


def answers(signatures: DataFrame) -> DataFrame:
    """signature, cost, audit of every distinct signature."""
    dealt = signatures.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")
    return dealt.mapInArrow(tidied(_answers), "signature string, cost long, audit string")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of rows under the rules of damage.

    The crc32 of ``conv_id:turn`` modulo 20 rules: 0 drops a row (no copies), 1
    empties its text, 2 takes its ends of sentences, 3 repeats it, 4 makes the
    user its author.  A null of any column is read as one space, but ids and
    turns stay null in the answer.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rule = F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn")).cast("binary")) % RULED
    text = F.when(F.col("rule") == 1, "").when(F.col("rule") == 2, F.translate("words", ENDS, "")).otherwise(F.col("words"))
    held = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), shown("role").alias("by"), shown("text").alias("words"), rule.alias("rule"))
    role = F.when(F.col("rule") == 4, "user").otherwise(F.col("by"))
    return held.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("rule") == 0, 0).when(F.col("rule") == 3, 2).otherwise(1).alias("copies"))


def _digests() -> list[Column]:
    """128 bits of role and text, which also order rows of one turn."""
    return [F.xxhash64("role", "text").alias("d1"), F.xxhash64("text", "role", F.lit("again")).alias("d2")]


def _order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.asc("d1"), F.asc("d2")]


STATS = "gaps long, blank long, duplicate long, truncated long, illegal long"
LEGAL = {"su", "ua", "au"}


class _Told:
    """Signature and counts of one conversation, row by row."""

    def __init__(self):
        self.letters: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.role = self.row = None

    def add(self, turn, d1, d2, initial: str, blank: bool, open_end: bool, again: bool, copies: int) -> None:
        for _ in range(copies):
            again, self.row = again or self.row == (turn, d1, d2), (turn, d1, d2)
            if self.role is not None:
                self.illegal += self.role + initial not in LEGAL
            self.role = initial
            if blank:
                self.blank += 1
            elif again:
                self.duplicate += 1
            elif open_end:
                self.truncated += 1
            self.letters.append("-" if blank or again else initial.upper() if open_end else initial)
            if turn is not None and turn != self.high:
                self.turns, self.high = self.turns + 1, turn
                self.low = turn if self.low is None else self.low

    def row_of(self, conv) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return conv, "".join(self.letters), gaps, self.blank, self.duplicate, self.truncated, self.illegal


def _signer(conv_type: pa.DataType):
    names = ["conv_id", "signature", "gaps", "blank", "duplicate", "truncated", "illegal"]
    types = [conv_type, pa.string(), *[pa.int64()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, told = None, None
        for batch in batches:
            out = []
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if told is None or conv != now:
                    if told is not None:
                        out.append(told.row_of(now))
                    now, told = conv, _Told()
                told.add(*row)
            yield _batch(out, names, types)
        if told is not None:
            yield _batch([told.row_of(now)], names, types)

    return run


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, signature and counts for every conversation, stored."""
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    keys = rows.select("conv_id", "turn", "copies", *_digests(), initial.alias("initial"), (last == "").alias("blank"), (~last.isin(*ENDS)).alias("open_end"))
    seen = F.struct(F.col("turn").isNotNull(), "turn")
    first = keys.where("copies > 0").groupBy("conv_id", "d1", "d2").agg(F.min(seen).alias("first")).toDF("conv", "e1", "e2", "first")
    same = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))
    marked = keys.join(first, same, "left").select("conv_id", "turn", "d1", "d2", "initial", "blank", "open_end", F.coalesce(seen > F.col("first"), F.lit(False)).alias("again"), "copies")
    dealt = marked.repartition("conv_id").sortWithinPartitions("conv_id", *_order())
    kind = rows.schema["conv_id"].dataType
    return stored(dealt.mapInArrow(tidied(_signer(_arrow(kind))), f"conv_id {kind.simpleString()}, signature string, {STATS}"), "signatures")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


class _Editor:
    """Applies the edits of one conversation to its rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NONE

    def _made(self) -> str:
        self.state = MADE[self.state]
        return NAMED[self.state]

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._made(), ""

    def edited(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """Rows that stand for one row, with what is inserted before it."""
        yield from self.inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = KEPT[role[0]][self.state]
            yield role, text
        elif edit == "R":
            yield self._made(), text


def _ordered(rows: DataFrame, told: DataFrame) -> DataFrame:
    """Answers (``head``) and rows of conversations, each answer before its rows."""
    there = rows.where("copies > 0").select("conv_id", F.lit(None).cast(told.schema["head"].dataType).alias("head"), "turn", *_digests(), "role", "text", "copies")
    heads = told.select("conv_id", "head", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("d1", "long"), ("d2", "long"), ("role", "string"), ("text", "string"), ("copies", "int"))])
    dealt = heads.unionByName(there).repartition("conv_id")
    return dealt.sortWithinPartitions("conv_id", F.col("head").isNull(), *_order()).select("conv_id", "head", "role", "text", "copies")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(conversation, its head, its repaired rows): heads have rows None; a list for each batch, and a last one."""
    now, head, editor = None, None, None
    for batch in byte_bounded(batches, "text"):
        out = []
        for conv, found, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if found is not None:
                if editor is not None:
                    out += [(now, head, r) for r in editor.inserts()]
                now, head, editor = conv, found, _Editor(found["audit"])
                out.append((now, head, None))
            else:
                for _ in range(copies):
                    out += [(now, head, r) for r in editor.edited(role, text)]
        yield out
    if editor is not None:
        yield [(now, head, r) for r in editor.inserts()]


def answered(rows: DataFrame) -> DataFrame:
    """conv_id, counts, cost and audit of every conversation: the first two passes."""
    signed = signatures(rows)
    return signed.join(answers(signed), "signature").drop("signature")


def audited(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``rows`` have conv_id, turn, role, text and copies (how often a row stands,
    adjacent; none: it counts for its conversation's being there alone), without
    nulls in role and text.  Rows are taken by turn, null turns first, rows of
    one turn by a hash of role and text, so repeated ones are adjacent.  A null
    conv_id is an id like others.  Roles whose initials are not s, u or a fit
    nowhere.  A conversation without rows has zeros, an empty audit and the hash
    of nothing; an empty table gives an empty table.
    """
    counts = [f.split()[0] for f in STATS.split(", ")]
    told = answered(rows)
    told = told.select("conv_id", F.struct(*counts, "cost", "audit").alias("head"))
    kind = rows.schema["conv_id"].dataType
    names = ["conv_id", *counts, "cost", "audit", "repaired_sha256"]
    types = [_arrow(kind), *[pa.int64()] * 6, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, any_line = None, None, False

        def done() -> tuple:
            return now[0], *(now[1][c] for c in names[1:8]), digest.hexdigest()

        for rows_ in _streamed(batches):
            out = []
            for conv, head, row in rows_:
                if row is None:
                    if now is not None:
                        out.append(done())
                    now, digest, any_line = (conv, head), hashlib.sha256(), False
                else:
                    digest.update(f"{chr(10) if any_line else ''}{row[0]}:{row[1]}".encode("utf-8", "surrogatepass"))
                    any_line = True
            yield _batch(out, names, types)
        if now is not None:
            yield _batch([done()], names, types)

    return _ordered(rows, told).mapInArrow(tidied(run), f"conv_id {kind.simpleString()}, {STATS}, cost long, audit string, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text: the rows of every conversation after the edits that ``audited`` names."""
    told = answered(rows).select("conv_id", F.struct("audit").alias("head"))
    kind = rows.schema["conv_id"].dataType
    types = [_arrow(kind), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for rows_ in _streamed(batches):
            out = []
            for conv, _, row in rows_:
                if row is None:
                    place = 0
                else:
                    out.append((conv, place, *row))
                    place += 1
            yield _batch(out, ["conv_id", "place", "role", "text"], types)

    return _ordered(rows, told).mapInArrow(tidied(run), f"conv_id {kind.simpleString()}, place long, role string, text string")
