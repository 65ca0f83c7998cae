"""Operators of the subpackage llm against plain versions, on small and odd tables."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from notes_engine.llm import byte_cnn, compaction, decision_list, decontaminate, graph, merkle, minhash_dedup, packing, ppm_core, ppm_scoring, quality_net, token_files, tokens
from notes_engine.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, kept string, score string, n int, shard string"  # the last clash with names used inside


def word(rng):
    return "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randint(1, 3)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


def odd_rows():
    """Nulls, blanks, repeats, ties, copies, a long text, a null id."""
    rng = random.Random(4)
    base = [prose(rng, rng.randint(20, 80)) for _ in range(25)]
    texts = [None, "", " \n\t ", "one", "One", "two words", *base, base[0], base[0].upper(), base[1] + " extra", " ".join(base[2].split()[:-1]), prose(rng, 30_000), "ÅÉ 日本 <|endoftext|> it's\x1cx"]
    rows = [(i, t, "en", "k", "s", 1, "z") for i, t in enumerate(texts)]
    return [*rows, rows[8], (None, base[3], None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(rows, width, percent):
    sets = {}
    for r in rows:
        sets.setdefault(r[0], []).append(shingles(r[1], width))
    ids, parent = [i for i in sets if i is not None], {}
    for i in ids:
        parent[i] = i

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(7, 7), (3, 2)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        return i if parent[i] == i else find(parent[i])

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(find(k) == v for k, v in got.items()) and set(got) >= {a for a, b in edges if a != b}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("block", [2000, 4])
def test_near_duplicates(spark, odd, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    if block == 4:
        monkeypatch.setattr(minhash_dedup, "TURNS", 0)  # everything is left to the blocks
    rng = random.Random(9)
    base = prose(rng, 60).split()
    chain = [(1000 + k, " ".join(base[k * 3 :] + prose(rng, k * 3).split()), None, None, None, None, None) for k in range(8)]
    rows = odd_rows() + chain
    out = minhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute_components(rows, 4, 80)
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    assert minhash_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_near_duplicates_with_clashing_and_null_ids(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(21)
    a, b, c, d, e = (prose(rng, 60) for _ in range(5))
    rows = [(1, a), (5, b), (5, a + " tail"), (5, c), (9, c + " end"), (7, d), (7, d.upper()), (7, d), (None, a + " more"), (None, e), (None, e), (None, e + " last")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    out = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df, width=5).collect()}
    assert {x for x in out if x[0] in (1, 5, 9)} == {(1, 56, 1, True), (5, 56, 5, True), (5, 57, 1, False), (9, 57, 5, False)}
    assert (None, 57, 1, False) in out and sum(x[3] for x in out if x[0] is None and x[2] is None) == 1
    got = pipeline.near_dedup(spark, df, "").collect()
    left = {(r.doc_id, r.text.lower()) for r in got}
    assert left - {(None, e), (None, e + " last")} == {(1, a), (5, b), (5, c), (7, d)} and len(got) == len(left) == 5
    assert {r.n for r in pipeline.near_dedup(spark, df.repartition(7), "").collect()} == {r.n for r in got}


def test_run_ids_match_the_tokenizer():
    from tokenizers import Tokenizer

    tok, ids = Tokenizer.from_file(tokens.tokenizer_path()), tokens.RunIds(tokens.tokenizer_path(), entries=5)
    texts = [r[1] or "" for r in odd_rows()[:-3]] + ["don't stop, we'll", "A.B c..d!! x2 \x85y\xa0z", "ǅ ẞ ﬁ Å é ı İ", "Σας ΣΑΣ"]
    for t in texts:
        assert np.frombuffer(ids.of([t], None)[0], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def plain_ids(text):
    from tokenizers import Tokenizer

    tok = plain_ids.__dict__.setdefault("tok", Tokenizer.from_file(tokens.tokenizer_path()))
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (5, 10**12), (3000, 4000), (2000, 10**7)):
        v = np.sort(rng.integers(0, top, n))
        ef, end = token_files.EliasFano.read(data := token_files.EliasFano.of(v).to_bytes(), 0)
        assert end == len(data) and ef.all().tolist() == v.tolist()
        assert [ef.select(i) for i in range(0, n, 7)] == v[::7].tolist()
        for x in rng.integers(0, top, 5):
            assert ef.find(int(x)) == int((v <= x).sum())
        if n == 2000:
            assert len(data) < 2000 * 15 / 8 * 1.15 + 100  # against 64 bits a number


def test_token_files(odd):
    files = token_files.write_token_files(odd, block_ids=500)
    out = token_files.read_token_files(files).collect()
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    assert len(out) == len(rows)
    got = sorted(out, key=lambda r: r.start)
    for r, (doc_id, text, *_) in zip(got, rows, strict=True):
        ids = plain_ids(text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    block = token_files.Block(bytes(files.orderBy("part", "before").first().payload))
    assert block.doc_of(block.start(block.n_docs - 1)) == block.n_docs - 1
    assert token_files.read_token_files(token_files.write_token_files(odd.limit(0))).count() == 0


def test_karmarkar_karp():
    rng = random.Random(5)
    for n, k in ((0, 1), (1, 3), (5, 5), (40, 6), (300, 32)):
        sizes = [rng.randint(1, 512) for _ in range(n)]
        part = packing.karmarkar_karp(sizes, k)
        sums = [sum(s for s, p in zip(sizes, part, strict=True) if p == j) for j in range(k)]
        assert len(part) == n and all(0 <= p < k for p in part)
        if n == 300:
            assert max(sums) - min(sums) <= 8
    part, k = packing.fit([60, 60, 60], 100)
    assert k == 3 and sorted(part) == [0, 1, 2]  # two windows would do by weight, not by capacity


def test_packing(odd):
    out = packing.packed(odd, group=4, slack=16).collect()
    texts = Counter((r[0], plain_ids(r[1]).tobytes()) for r in odd_rows())
    by_seq, by_doc = {}, {}
    for r in out:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 2048
    assert sum(r.length for r in out) == sum(len(b) // 4 * n for (_, b), n in texts.items())
    for (doc_id, b), n in texts.items():
        if n == 1:
            pieces, at = sorted(by_doc[doc_id], key=lambda p: p.start), 0
            for p in pieces:
                assert p.start == at and p.doc_tokens == len(b) // 4 and p.ids_crc32 == zlib.crc32(b[4 * at : 4 * (at + p.length)])
                at += p.length
            assert at == len(b) // 4
    assert packing.packed(odd.limit(0)).count() == 0


def test_packing_over_many_partitions(spark):
    rng = random.Random(41)
    df = spark.createDataFrame([(i, prose(rng, rng.randint(50, 400))) for i in range(640)], "doc_id long, text string")
    for parts in (1, 24):
        rows = packing.packed(df.repartition(parts, "doc_id")).collect()
        got, whole, k = Counter(), {r.doc_id: r.doc_tokens for r in rows}, len({r.sequence_id for r in rows})
        for r in rows:
            got[r.doc_id] += r.length
        assert got == whole and len(whole) == 640
        assert k <= -(-sum(whole.values()) // packing.CAPACITY) + 2  # windows more than full ones, whatever the partitions


def test_ppm_is_a_distribution():
    rng = random.Random(6)
    words = [word(rng).encode() for _ in range(400)]
    counts = np.array([rng.randint(1, 9) for _ in words])
    grams, owner = ppm_scoring.inner_grams(words)
    keys, at = np.unique(grams, return_inverse=True)
    n = np.bincount(at, weights=counts[owner])
    ctx = next(k for k in keys.tolist() if k >> 56 == ppm_scoring.ORDER)
    probe = np.array([(ctx & ~255) | b for b in range(256)], np.uint64)  # every symbol in one context
    full = np.unique(np.concatenate([keys, probe]))
    cnt = np.zeros(len(full))
    cnt[np.searchsorted(full, keys)] = n
    pairs = np.zeros((256, 256))
    np.add.at(pairs, (((full >> np.uint64(8)) & np.uint64(255)).astype(int), (full & np.uint64(255)).astype(int)), cnt)
    low = ppm_core.LowOrders(pairs)
    key, length = full & np.uint64((1 << 56) - 1), (full >> np.uint64(56)).astype(int)
    logp = ppm_core.code_shard(key, length, cnt, low, ppm_core.escape_table(ppm_core.escape_cases(key, length, cnt), low))
    assert abs((10 ** logp[np.searchsorted(full, probe)]).sum() - 1) < 0.05  # escapes of exhausted contexts are lost


def test_ppm_adds_up_when_orders_are_passed_over():
    rng = random.Random(16)
    rows = {}
    for _ in range(3000):  # skewed symbols after contexts of few letters: many contexts of every order are passed over
        ctx, sym = [rng.choice(b"abcd") for _ in range(6)], min(int(rng.expovariate(0.5)), 25) + 97
        ctx[5] = rng.choice((ctx[5], ord("a")))
        key = sum(x << 8 * j for j, x in enumerate([sym, *ctx]))
        rows[key] = rows.get(key, 0) + rng.choice((1, 1, 4, 9))
    keys = np.array(sorted(rows), np.uint64)
    n = np.array([rows[int(k)] for k in keys], float)
    pairs = np.zeros((256, 256))
    np.add.at(pairs, (((keys >> np.uint64(8)) & np.uint64(255)).astype(int), (keys & np.uint64(255)).astype(int)), n)
    low = ppm_core.LowOrders(pairs)
    escapes = ppm_core.escape_table(ppm_core.escape_cases(keys, np.full(len(keys), 6), n), low)
    for ctx in np.unique(keys >> np.uint64(8))[::40].tolist():
        probe = np.array([ctx << 8 | b for b in range(256)], np.uint64)
        full = np.unique(np.concatenate([keys, probe]))
        cnt = np.zeros(len(full))
        cnt[np.searchsorted(full, keys)] = n
        logp = ppm_core.code_shard(full, np.full(len(full), 6), cnt, low, escapes)
        assert abs((10 ** logp[np.searchsorted(full, probe)]).sum() - 1) < 1e-9


def test_ppm_contexts_hold_six_bytes(spark):
    keys, _ = ppm_scoring.inner_grams([b"qabcdefg"])
    whole = [k for k in keys.tolist() if k & 255 == ord("g")]
    assert whole == [6 << 56 | int.from_bytes(b"abcdefg", "big")]
    train = [(5 * i, f"{a}bcdef{z} " * 40) for i in range(4) for a, z in (("x", "p"), ("y", "q"))]  # the sixth byte back tells the last
    df = spark.createDataFrame([*train, (1, "xbcdefp"), (2, "xbcdefq")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in ppm_scoring.scored(df, F.col("doc_id") % 5 != 0).collect()}
    assert score[1] > score[2] + 1


def test_ppm_scoring(spark, odd):
    held = F.col("doc_id") % 5 == 2
    out = ppm_scoring.scored(odd, held, chunk_tokens=300).collect()
    rows = odd_rows()
    c = Counter()
    for r in rows:
        if r[0] is None or r[0] % 5 != 2:
            c.update((r[1] or "").encode().lower().split())
            c[b"\n"] += 1
    n, v = sum(c.values()), len(c)
    want = {}
    for r in rows:
        w = [*(r[1] or "").encode().lower().split(), b"\n"]
        want[r[0]] = (len(w), sum(x in c for x in w), sum(np.log10((c.get(x, 0) + 1) / (n + v + 1)) for x in w))
    assert len(out) == len(rows)
    for r in out:
        assert r.train_tokens == n and (r.n_tokens, r.n_known) == want[r.doc_id][:2]
        assert abs(r.base_score - want[r.doc_id][2]) < 1e-6 * abs(want[r.doc_id][2]) + 1e-9 and r.score < 0
    one = {r.doc_id: r.score for r in out}
    two = {r.doc_id: r.score for r in ppm_scoring.scored(odd.repartition(3), held).collect()}
    assert all(abs(one[k] - two[k]) < 1e-6 * abs(one[k]) for k in one)  # whatever the chunks
    assert ppm_scoring.scored(odd.limit(0), held).count() == 0
    assert ppm_scoring.scored(odd, F.lit(True)).count() == len(rows)  # nothing to learn from


def test_statistics(odd):
    from re import split

    for r in decision_list.with_stats(odd.select("doc_id", "text")).collect():
        text = r.text or ""
        w = [x for x in split(r"[\x20\x09-\x0D]+", text) if x]
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        rep = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if split(r"[\x20\x09-\x0D]+", x) not in ([""], ["", ""])]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text))
        assert (r.n_repeat_words, r.n_dup_lines) == (len(rep), len(lines) - len(set(lines)))


def test_repeats_in_statistics(spark):
    cases = {"a b c d e a b c d e": 10, "a a a a a a": 6, "a b c d e f": 0, "x a b c d e y z a b c d e": 10}
    got = {r.text: r.n_repeat_words for r in decision_list.with_stats(spark.createDataFrame([(t,) for t in cases], "text string")).collect()}
    assert got == cases


def test_decision_list(spark):
    rng = np.random.default_rng(8)
    x = {f: rng.random(900) for f in decision_list.FEATURES}
    bad = (x["symbol_share"] > 0.9) | ((x["upper_share"] > 0.7) & (x["mark_share"] > 0.6))
    rules = decision_list.learn(x, bad)
    got = np.zeros(900, bool)
    for r in rules:
        got |= decision_list._covers(r, x, 900)
    assert (got == bad).mean() > 0.97 and (got & ~bad).mean() < 0.02
    assert decision_list.learn(x, np.zeros(900, bool)) == []
    df = spark.createDataFrame([(1, "word " * 9), (2, " ".join(f"w{i}" for i in range(30)))], "doc_id long, text string")
    assert [r.kept for r in decision_list.judged(df, []).orderBy("doc_id").collect()] == [False, True]
    plan = decision_list.judged(df, rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_merkle(spark):
    rows = [(i, f"http://x/{i}", f"page {i}" * (1 + i % 3)) for i in range(300)] + [(None, "u", "h"), (7, "again", "x"), (400, None, None)]
    df = spark.createDataFrame(rows, "number long, url string, html string")
    rec = lambda d: d.select("number", merkle.warc_record(F.col("url"), F.col("html")).alias("record"))
    other = df.where("number is null or number != 33").withColumn("html", F.when(F.col("number") == 77, "flipped").otherwise(F.col("html"))).unionByName(spark.createDataFrame([(999, "s", "s")], df.schema))
    out = {r.number: r for r in merkle.audit(rec(df), rec(other), per_file=64).collect()}
    assert {k: r.status for k, r in out.items() if r.status != "ok"} == {33: "missing", 77: "corrupt", 999: "surplus"}
    assert out[64].offset == 0 and out[65].offset == out[64].length
    assert all(r.status == "ok" for r in merkle.audit(rec(df), rec(df)).collect())
    assert {r.status for r in merkle.audit(rec(df), rec(df.limit(0))).collect()} == {"missing"}
    assert merkle.audit(rec(df.limit(0)), rec(df.limit(0))).count() == 0


def test_compaction_plan():
    assert compaction.plan({}) == [] and compaction.plan({"a": 5, "b": 6}) == []
    groups = compaction.plan({f"s{i:02d}": 100 for i in range(20)}, least=10, target=800)
    assert sorted(n for g in groups for n in g) == sorted({n for g in groups for n in g}) and all(len(g) >= 4 for g in groups)
    assert not any("big" in g for g in compaction.plan({"big": 10**9, **{f"s{i}": 100 for i in range(4)}}, least=10, target=1000))


def test_compaction(spark, odd, tmp_path):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/store")
    assert store.read().count() == 0
    for _ in range(2):
        store.append(odd.repartition(2), compaction.arrivals(odd, 3))
    before = store.manifest()
    after = store.compact(least=1, target=1 << 30)
    assert after.version == before.version + 1 and len(after.shards) < len(before.shards)
    count = lambda m: Counter((r.doc_id, r.text, r.shard) for r in store.read(m).collect())
    assert count(after) == count(before) == Counter({k: 2 * v for k, v in Counter((r[0], r[1], r[6]) for r in odd_rows()).items()})
    assert store.vacuum() and count(after) and store.manifest().version == after.version
    with pytest.raises(compaction.Conflict):
        store.commit(compaction.Manifest(after.version, "", 0, {}))
    assert store.compact(least=1, target=1).version == after.version  # nothing below the target size
    store.append(odd.limit(0), compaction.arrivals(odd))
    assert count(store.manifest())


def test_decontamination(spark, odd):
    rng = random.Random(3)
    item = prose(rng, 40).split()
    changed = item[:18] + ["new"] + item[19:]
    items = [(1, " ".join(item)), (2, "zebra quagga"), (3, None), (4, " "), (1, " ".join(item)), (5, prose(rng, 16))]
    docs = [*odd_rows(), (500, prose(rng, 3000) + " " + " ".join(item).upper() + "\n" + prose(rng, 50), *[None] * 5), (501, "x " + " ".join(changed), *[None] * 5), (502, "a zebra quagga b", *[None] * 5), (503, " ".join(item[:20]), *[None] * 5)]
    out = decontaminate.contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.n_found, r.n_shingles) for r in out.collect()}
    assert got == {(500, 1): (36, 36), (501, 1): (31, 36), (502, 2): (1, 1)}
    assert decontaminate.contaminated(odd.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.contaminated(odd, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontamination_with_null_ids(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(31)
    one, two = prose(rng, 30), prose(rng, 30)
    items = spark.createDataFrame([(1, one), (None, two)], "item_id long, text string")
    docs = spark.createDataFrame([(None, "a " + one), (None, prose(rng, 40)), (7, two + " b"), (7, prose(rng, 40)), (8, "c " + one)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.n_found) for r in decontaminate.contaminated(docs, items).collect()} == {(None, 1, 26), (7, None, 26), (8, 1, 26)}
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {(r.doc_id, r.text) for r in pipeline.decontamination(spark, docs, str(tmp_path)).collect()}
    rows = docs.collect()
    assert left == {(None, rows[1].text), (7, rows[3].text)}  # clean rows stay, whatever shares their id


def test_language(spark, odd):
    rng = random.Random(7)
    alphabets = {"en": ["the", "and", "ing", "wh"], "xx": ["ñu", "ció", "que", "zo"]}
    rows = [(i, " ".join("".join(rng.choice(alphabets[k]) for _ in range(3)) for _ in range(30)), k) for i in range(200) for k in [("en", "xx")[i % 2]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = byte_cnn.trained(df.where("doc_id % 4 != 2"))
    out = byte_cnn.with_language(df.where("doc_id % 4 = 2"), net).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97 and all(0 <= r.score <= 1 for r in out)
    und = {r.doc_id: r.lang_pred for r in byte_cnn.with_language(odd.select("doc_id", "text"), net).collect()}
    assert [und[i] for i in (0, 1, 2)] == ["und"] * 3 and und[3] in alphabets
    assert byte_cnn.with_language(odd.select("doc_id", "text").limit(0), net).count() == 0
    assert byte_cnn.trained(df.limit(0)) is None
    assert {r.lang_pred for r in byte_cnn.with_language(df, None).collect()} == {"und"}


def test_quality(spark, odd):
    rng = random.Random(7)
    rows = [(i, prose(rng, 40) if i % 3 else " ".join(w + "$$$" for w in prose(rng, 40).split())) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))
    net = quality_net.trained(df.where("doc_id % 5 != 0"), labels)
    out = {r.doc_id: r.score for r in quality_net.scored(df, net).collect()}
    assert np.mean([(out[i] >= 0.5) == bool(i % 3) for i in range(0, 240, 5)]) > 0.97
    assert len([1 for r in quality_net.scored(odd, net).collect() if 0 <= r.score <= 1]) == len(odd_rows())
    empty = quality_net.trained(df.limit(0), labels)
    assert quality_net.scored(df, empty).where("score between 0 and 1").count() == 240


def test_quality_learns_from_whole_texts(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 4000) + " " + " ".join(w + ("$$$" if i % 2 else "") for w in prose(rng, 4000).split())) for i in range(60)]
    rows += [(1000, "zyx " + prose(rng, 20)), (1001, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    context = quality_net.contexts(df)
    at = [t >> 16 for t in quality_net.Tokens().of(quality_net.runs(rows[-2][1])).tolist()]
    own = quality_net.index_vectors(quality_net.WORDS, 1)
    want = own[at[1]] + own[at[2]]  # a word of an unlabelled text, of which 20,000 others need not know
    assert np.allclose(context[at[0]], want / np.linalg.norm(want), atol=1e-5)
    assert (quality_net.contexts(df.repartition(5)) == context).all()
    net = quality_net.trained(df, df.where("doc_id < 1000").select("doc_id", (1 - F.col("doc_id") % 2).alias("quality")))
    pooled = np.stack([net.vectors.value.pool(quality_net.runs(t), quality_net.Tokens()) for _, t in rows[:60]])
    assert np.allclose(net.mean, pooled.mean(0), atol=1e-5)  # of whole texts


def test_pipeline(spark, odd, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    docs = [(100 + i, prose(rng, 50), "en", "k", "s", 1, "z") for i in range(60)]
    docs += [(300, docs[0][1] + " tail", "en", "k", "s", 1, "z"), (301, "x " * 60, "en", "k", "s", 1, "z"), (302, docs[5][1] + " " + docs[6][1], "en", "k", "s", 1, "z")]
    item = " ".join(docs[6][1].split()[5:45])
    path = str(tmp_path)
    spark.createDataFrame(docs, SCHEMA).unionByName(odd).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    table = spark.read.parquet(f"{path}/documents.parquet")
    kept = table
    for _, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, path)
        assert kept.columns == table.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    clean = {100 + i for i in range(60)} - {106}
    assert clean <= set(ids) and not {300, 301, 302, 106, 0, 1, 2} & set(ids) and len(ids) == len(set(ids))
    out = pipeline.run(spark, path).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id for r in out} == set(ids) and all(r.n == r.m for r in out)
