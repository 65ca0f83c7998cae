"""Operators 11 to 13 against brute force, on small and odd tables."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notes_engine.llm import conversation_repair as repair
from notes_engine.llm import fingerprints, whitening
from notes_engine.llm.common import drop_stored
from tests.llm.test_llm import SCHEMA, brute_components, odd_rows, prose, shingles

INSERTS = ["", "u", "a", "ua", "au", "uu", "aa"]


def every_repair(letters):
    """(cost, audit) of the best of all edits of a signature, by trying them all."""
    best = (math.inf, "")
    ways = []
    for c in letters:
        own, extra = c.lower(), 1 if c.isupper() else 0
        ways.append([("D", "", 3)] if c == "-" else [("D", "", 3), ("K", own, extra), ("R", "u", 2 + extra), ("R", "a", 2 + extra)])
    for edits in itertools.product(*ways):
        base, audit = sum(e[2] for e in edits), "".join(e[0] for e in edits)
        if base > best[0]:
            continue
        for gaps in itertools.product(INSERTS, repeat=len(letters) + 1):
            cost = base + 2 * sum(map(len, gaps))
            if cost > best[0]:
                continue
            roles = gaps[0] + "".join(e[1] + g for e, g in zip(edits, gaps[1:], strict=True))
            if re.fullmatch("(s?(ua)+)?", roles):
                audit = "I" * len(gaps[0]) + "".join(e[0] + "I" * len(g) for e, g in zip(edits, gaps[1:], strict=True))
                best = min(best, (cost, audit))
    return best


def test_trie_answers_equal_all_edits_tried():
    rng = random.Random(5)
    some = sorted({"".join(rng.choice("suaxSUAX-") for _ in range(rng.randint(0, 4))) for _ in range(60)})
    trie = repair.Trie()
    for s in some:
        assert trie.answer(s) == every_repair(s), s


def plain_answer(letters):
    """The same by a table of whole strings, for longer signatures."""
    now = {0: (0, "")}
    step = {0: 2, 1: 2, 2: 3, 3: 2}

    def with_inserts(table):
        out = dict(table)
        for _ in range(3):
            for s, (c, a) in list(out.items()):
                out[step[s]] = min(out.get(step[s], (math.inf, "")), (c + 2, a + "I"))
        return out

    for x in letters:
        after, stays = {}, 1 if x.isupper() else 0
        for s, (c, a) in with_inserts(now).items():
            ways = [(s, 3, "D")]
            if x != "-":
                ways.append((step[s], 2 + stays, "R"))
                if (x.lower(), s) in {("s", 0), ("u", 0), ("u", 1), ("u", 3), ("a", 2)}:
                    ways.append(({"s": 1, "u": 2, "a": 3}[x.lower()], stays, "K"))
            for t, more, e in ways:
                after[t] = min(after.get(t, (math.inf, "")), (c + more, a + e))
        now = after
    return min(v for s, v in with_inserts(now).items() if s in (0, 3))


def test_trie_shares_prefixes_of_long_signatures():
    rng = random.Random(6)
    base = "".join(rng.choice("suauaua-xUA") for _ in range(300))
    some = sorted({base[: rng.randint(0, 300)] + "".join(rng.choice("sua-A") for _ in range(rng.randint(0, 40))) for _ in range(50)})
    trie = repair.Trie()
    for s in some:
        assert trie.answer(s) == plain_answer(s)
    assert len(trie.layers.known) < 400  # distinct layers, not nodes


def brute_conversations(rows):
    """Answers of conversations from rows (conv, turn, role, text), plainly."""
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        r = zlib.crc32(":".join(shown).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if r == 0:
            continue
        text = "" if r == 1 else re.sub("[.!?]", "", text) if r == 2 else text
        mine += [(turn, "user" if r == 4 else role, text)] * (2 if r == 3 else 1)
    out = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0))
        seen, letters, counts, illegal = set(), [], [0, 0, 0], 0
        for i, (_, role, text) in enumerate(mine):
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                counts[fault] += 1
            kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
            letters.append("-" if fault < 2 else kind.upper() if fault == 2 else kind)
            illegal += bool(i and (mine[i - 1][1][:1] + role[:1]) not in ("su", "ua", "au"))
        turns = {t for t, _, _ in mine if t is not None}
        cost, audit = plain_answer(letters)
        left, lines, state = list(mine), [], 0
        for e in audit:
            if e != "I":
                _, role, text = left.pop(0)
            if e in "IR":
                role, text = ("assistant" if state == 2 else "user"), ("" if e == "I" else text)
            if e != "D":
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
                lines.append(f"{role}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def odd_conversations():
    rng = random.Random(9)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            text = rng.choice([None, "", " \t\n", "Yes.", "no", "Why? ", "same text!", "tail\x1c", "é. \n", f"own {c}"])
            rows.append((c, rng.choice([t, t, t, t + 3]) if c % 7 else t, rng.choice(["system", "user", "assistant", "tool", "", None, "usher"]), text))
    seen, out = set(), []
    for r in rows:  # one row for each turn, since the order within a turn is by hash
        if (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            out.append(r)
    out += [(100, None, "user", "x."), (None, 1, "user", "x."), (None, 2, "assistant", "y."), (101, 5, "user", "r."), (101, 5, "user", "r."), (102, 1, "assistant", "long " * 200_000)]
    out += [(200, t, rng.choice(["user", "assistant"]), f"{t}.") for t in range(3000)]  # a hot conversation
    return out


def test_conversations_against_brute_force(spark):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("signature", F.lit("s")).withColumn("copies", F.lit(9)).withColumn("head", F.lit(1))
    got = {r[0]: tuple(r[1:]) for r in repair.audited(repair.damaged(df)).collect()}
    assert got == brute_conversations(rows)
    assert repair.audited(repair.damaged(df.limit(0))).count() == 0
    lines = {}
    for r in repair.repaired(repair.damaged(df)).orderBy("place").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, told in got.items():
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == told[-1]
    drop_stored(spark)


def test_rows_of_one_turn_are_taken_by_hash(spark):
    rows = [(1, 7, "user", "a."), (1, 7, "assistant", "b."), (1, 7, "user", "a."), (2, None, "user", "q."), (2, None, "user", "q.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("copies", F.lit(1))
    got = {r.conv_id: r for r in repair.audited(df).collect()}
    again = {r.conv_id: r for r in repair.audited(df.orderBy(F.desc("text"), F.desc("role"))).collect()}
    assert got == again and got[1].duplicate == 1 and got[2].duplicate == 1 and got[2].gaps == 0


def plain_edits(rows):
    """doc_id, text and edited text by ascending id."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, (doc_id, text, *_) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        yield doc_id, text, text[: len(text) - half] + after[:half], after


def hexed(print_):
    return print_.astype("<u2").tobytes().hex()


@pytest.mark.parametrize("shuffled", [False, True])
def test_fingerprints_against_brute_force(spark, shuffled):
    rows = [r for i, r in enumerate(odd_rows()) if i != len(odd_rows()) - 2]  # without the repeated row
    if shuffled:
        random.Random(1).shuffle(rows)
    else:
        rows.pop()  # a null id is unordered
    df = spark.createDataFrame(rows, SCHEMA).withColumn("unit", F.lit("x")).withColumn("first", F.lit(True)).repartition(1).sortWithinPartitions("doc_id") if not shuffled else spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in fingerprints.fingerprinted(df).collect()}
    signer, classes = fingerprints.Signer(), brute_components(rows, 5, 80)
    assert len(got) == len(rows)
    for doc_id, text, changed, after in plain_edits(rows):
        r = got[doc_id]
        sizes, _, prints = signer.of([text, changed, after])
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (hexed(prints[0]), hexed(prints[1]))
        assert r.near_edited == fingerprints.likeness(prints[0], sizes[0], prints[1], sizes[1])
        assert r.near_next == fingerprints.likeness(prints[0], sizes[0], prints[2], sizes[2])
        if doc_id is not None:
            assert r.class_id == classes[doc_id]
    drop_stored(spark)


def test_likeness_estimates_jaccard():
    rng = random.Random(3)
    words = prose(rng, 600).split()
    signer = fingerprints.Signer()
    for cut in (0, 60, 200, 400):
        a, b = " ".join(words), " ".join(words[cut:])
        sa, sb = shingles(a, 5), shingles(b, 5)
        _, _, prints = signer.of([a, b])
        assert abs((prints[0] == prints[1]).mean() - len(sa & sb) / len(sa | sb)) < 0.13


def test_fingerprints_of_edge_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fingerprints.fingerprinted(none).count() == 0
    one = fingerprints.fingerprinted(spark.createDataFrame([(5, "a b c d e f", *[None] * 5)], SCHEMA)).first()
    assert one.edited_sha256 == hashlib.sha256(b"a b c a b c"[:6] + b"a b c").hexdigest() and one.near_next == 1.0
    twice = spark.createDataFrame([(1, "x y", *[None] * 5), (1, "x y", *[None] * 5), (0, "", *[None] * 5), (2, None, *[None] * 5)], SCHEMA)
    got = fingerprints.fingerprinted(twice).collect()
    assert len(got) == 4 and {r.near_next for r in got if r.doc_id == 2} == {1.0}  # the first is empty too
    drop_stored(spark)


def test_runs_across_tasks(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(1, 40))) for i in range(300)]
    whole = {r.doc_id: r for r in fingerprints.edited(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    for df in (spark.createDataFrame(rows, "doc_id long, text string").repartition(7), spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id")):
        assert {r.doc_id: r for r in fingerprints.edited(df).collect()} == whole
    drop_stored(spark)


def test_runs_across_batches(spark):
    """A run of rising ids that fills a batch and goes on in the next one."""
    batch = lambda ids: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], names=["doc_id"])
    for ids in itertools.product(range(4), repeat=4):
        cuts = [0, *[k for k in range(1, 4) if ids[k] <= ids[k - 1]], 4]
        plain = [{"low": ids[a], "high": ids[b - 1]} for a, b in itertools.pairwise(cuts)]
        for sizes in ((4,), (1, 3), (2, 2), (3, 1), (0, 2, 0, 2), (1, 1, 1, 1)):
            at = [0, *itertools.accumulate(sizes)]
            out = fingerprints._run_ends(iter([batch(ids[a:b]) for a, b in itertools.pairwise(at)]))
            assert [r for b in out for r in b.to_pylist()] == plain, (ids, sizes)
    rng = random.Random(9)
    df = spark.createDataFrame([(i, prose(rng, rng.randint(1, 40))) for i in range(300)], "doc_id long, text string").coalesce(1)
    whole = sorted(fingerprints.edited(df).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert sorted(fingerprints.edited(df).collect()) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        drop_stored(spark)


def test_classes_hold_every_link_of_large_groups(spark, monkeypatch):
    """A group of near copies and texts that share a passage below the threshold."""
    rng = random.Random(12)
    base, part = prose(rng, 120).split(), prose(rng, 60)
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, f"{part} {prose(rng, 60)}") for i in range(150)] + [(5000 + i, rows[i % 40][1]) for i in range(100)]
    got = {r.doc_id: r.class_id for r in fingerprints.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows, 5, 80)
    drop_stored(spark)


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(90, 20)) @ rng.normal(size=(20, 20)) * 0.2).astype(np.float32)
    rows = [(i, [float(c) for c in v], i) for i, v in enumerate(vectors)]
    rows += [(500, rows[3][1], 0), (500, rows[3][1], 0), (None, rows[4][1], 0), (501, None, 0), (502, [], 0), (503, [*rows[0][1][:19], None], 0), (504, [*rows[0][1][:19], math.nan], 0)]
    rows += [(505, [*rows[0][1][:19], math.inf], 0), (506, [-math.inf, *rows[0][1][1:]], 0), (507, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int").withColumn("white", F.lit(1))
    got = whitening.whitened(df).orderBy("vec_id", "component").collect()
    assert len(got) == 93 * 16
    x = np.floor(64 * vectors.astype(float)).astype(int) + 1_000_000
    u = np.unique(x, axis=0)
    n, total = len(u), u.sum(0)
    centre = (u * n - total) / n
    cov = centre.T @ centre / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1].T
    true = ((x * n - total) / n) @ (q / np.sqrt(e)[:, None]).T
    signs = {}
    for r in got:
        i = {None: 4, 500: 3}.get(r.vec_id, r.vec_id)
        sign = signs.setdefault(r.component, np.sign(r.whitened * true[i, r.component - 1]))
        assert abs(r.whitened - sign * true[i, r.component - 1]) < 1e-9
        assert r.n == n and r.deviation == ((x[i] * n - total) ** 2).sum() and abs(r.explained - e[r.component - 1] / np.trace(cov)) < 1e-12 and r.identity_error < 1e-9
    drop_stored(spark)


def test_whitening_of_edge_tables(spark):
    kind = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whitened(spark.createDataFrame(rows, kind)).count() == 0
    got = whitening.whitened(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0])], kind)).collect()
    assert len(got) == 2 and {r.component for r in got} == {1} and sorted(round(r.whitened, 9) for r in got) == [-1.0, 1.0]
    far = whitening.whitened(spark.createDataFrame([(1, [1e300, 0.5]), (2, [-1e300, 1.0]), (3, [0.0, 0.0])], kind)).collect()
    assert {r.deviation for r in far} == {None} | {r.deviation for r in far if r.vec_id == 3} and max(r.identity_error for r in far) < 1e-4
    assert (whitening.triangle_sums(spark.createDataFrame([(1, 2, 3), (4, 5, 6)], "a long, b long, c long"), ["a", "b", "c"], most=2) == [[17, 22, 27], [22, 29, 36], [27, 36, 45]]).all()
    drop_stored(spark)


def test_shapes_of_whole_words():
    from notes_engine.llm import quality_net as q

    assert q.shape(b"") == 0 and q.shape(b"Abc!") != q.shape(b"abc!") and q.shape(b"aa11") == q.shape(b"b2")
    long = [b"a1" * k for k in range(4, 40)]
    assert all(q.SHORT <= q.shape(w) < q.SHAPES for w in long) and len({q.shape(w) for w in long}) > 30  # not their first classes alone
    assert max(q.shape(bytes(c)) for c in itertools.product(b"A$", repeat=6)) < q.SHORT


def test_decision_list_takes_text_ids(spark):
    from notes_engine.llm import decision_list

    rng = random.Random(3)
    rows = [(f"d{i}", prose(rng, 60) if i % 2 else " ".join(w + "#$" for w in prose(rng, 60).split())) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = docs.select("doc_id", F.when(F.substring("doc_id", 2, 9).cast("int") % 2 == 1, 1).otherwise(0).alias("quality"))
    rules = decision_list.learned_from(docs, labels)
    got = {r.doc_id: r.kept for r in decision_list.judged(docs, rules).collect()}
    assert rules and all(got[f"d{i}"] == bool(i % 2) for i in range(200))
