"""Operators of the subpackage llm against plain versions in full, faults that were mended, and all entry points."""

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from notes_engine.llm import byte_cnn, common, compaction, decision_list, merkle, minhash_dedup, ppm_core, ppm_scoring, quality_net, queries

from .test_llm import SCHEMA, brute_components, odd, odd_rows, prose  # noqa: F401  (odd is a fixture)

SF = "/root/testdata/sf0.01"


# Sampling, sieves, scratch tables.


def test_sampled_takes_about_as_many_as_asked(spark):
    ids = spark.range(20_000)
    assert common.sampled(ids, F.col("id"), 50_000, 20_000).count() == 20_000
    got = {r.id for r in common.sampled(ids, F.col("id"), 2_000, 20_000).collect()}
    assert 1_700 < len(got) < 2_300 and got == {r.id for r in common.sampled(ids.repartition(7), F.col("id"), 2_000, 20_000).collect()}


def test_sieve_holds_all_of_its_table(spark):
    keys = spark.range(3_000).select(F.xxhash64("id").alias("h"))
    bits, h = common.sieve(keys, F.col("h")), F.xxhash64("id")
    got = {r.id for r in spark.range(30_000).where(common.may_hold(bits, h)).collect()}
    assert set(range(3_000)) <= got and len(got) < 3_100
    none = common.sieve(keys.limit(0), F.col("h"))
    assert spark.range(10).where(common.may_hold(none, h)).count() == 0


def test_scratch_tables_are_deleted(spark):
    a, b = common.stored(spark.range(3), "a"), common.stored(spark.range(3), "b")
    common.release(a, None, spark.range(1))
    assert not os.path.exists(a.stored_at.removeprefix("file://")) and b.count() == 3
    assert common.drop_stored(spark) >= 1 and not os.path.exists(b.stored_at.removeprefix("file://"))


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Context(), Context()

    with pytest.raises(RuntimeError):
        common.scratch_dir(Session())


# Column names that clash.


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "the " * 30, "x", "y", 7, "w", "z")], "doc_id long, text string, `Score` string, lang_pred string, kept int, _w string, `a.b` string")
    net = byte_cnn.ByteCNN(["en", "fr"])
    out = byte_cnn.with_language(df, net)
    assert out.columns == ["doc_id", "text", "kept", "_w", "a.b", "lang_pred", "score"] and out.first().lang_pred in net.classes
    out = decision_list.judged(df, [])
    assert len(out.columns) == len({c.lower() for c in out.columns}) and {"_w", "a.b", "Score"} <= set(out.columns)
    row = out.first()
    assert row.kept is False and row._w == "w" and row.n_words == 30


# Compaction.


def test_compaction_keeps_the_column_that_names_shards(spark, tmp_path):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/s")
    df = spark.createDataFrame([(1, "en", "a"), (2, None, "b"), (3, "x y/%=", "c"), (4, "null", "d"), (4, "null", "d")], "doc_id long, lang string, _shard string").withColumnsRenamed({"_shard": "_Shard"})
    store.append(df, "lang")
    store.append(df.limit(0), "lang")
    store.append(df.withColumn("_shard_id", F.lit("mine")), "lang")
    want = Counter((r.doc_id, r.lang, r._Shard) for r in df.collect())
    whole = lambda: store.read(shard=None).collect()
    twice = {k: 2 * v for k, v in want.items()}
    assert Counter((r.doc_id, r.lang, r._Shard) for r in whole()) == twice
    store.compact(fan=2, least=1, target=1 << 30)
    assert len(store.manifest().shards) < 8 and Counter((r.doc_id, r.lang, r._Shard) for r in whole()) == twice
    assert sorted(str(r._shard_id) for r in whole()) == ["None"] * 5 + ["mine"] * 5
    assert store.read().where("_shard_id is null").count() == 0
    store.vacuum()
    assert Counter((r.doc_id, r.lang, r._Shard) for r in whole()) == twice


def test_a_lost_writer_does_not_wedge_the_store(spark, tmp_path):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(spark.range(3), F.lit(1))
    torn = tmp_path / "s" / "manifest" / "v00000002.json"
    torn.write_text('{"version": 2, "sch')
    assert store.manifest().version == 1
    with pytest.raises(compaction.Conflict):  # its writer may still be at work
        store.append(spark.range(3), F.lit(2))
    os.utime(torn, (1, 1))
    assert store.append(spark.range(4), F.lit(2)).version == 3 and store.read().count() == 7  # number 2 stays unused
    assert torn.read_text() == '{"version": 2, "sch'
    with pytest.raises(LookupError):
        (tmp_path / "s" / "manifest" / "v00000009.json").write_text("")
        store.manifest(9)


def test_appends_with_other_columns(spark, tmp_path):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(spark.createDataFrame([(1, "x"), (2, None)], "a long, b string"), F.lit(1))
    store.append(spark.createDataFrame([(3,)], "a long"), F.lit(1))
    store.append(spark.createDataFrame([(1.5, 4)], "c double, A long"), F.lit(1))
    want = {(1, "x", None), (2, None, None), (3, None, None), (4, None, 1.5)}
    assert {(r.a, r.b, r.c) for r in store.read(shard=None).collect()} == want
    runs = set(os.listdir(tmp_path / "s" / "data"))
    with pytest.raises(compaction.SchemaConflict):
        store.append(spark.createDataFrame([("5",)], "a string"), F.lit(1))
    assert set(os.listdir(tmp_path / "s" / "data")) == runs and store.manifest().version == 3
    store.compact(fan=2, least=1, target=1 << 30)
    store.vacuum()
    assert {(r.a, r.b, r.c) for r in store.read(shard=None).collect()} == want


def test_two_writers_and_a_stale_claim(spark, tmp_path, monkeypatch):
    """A writer that was only slow, and two that pass its claim over: no finished version is lost."""
    path = f"file://{tmp_path}/s"
    a, b, slow = (compaction.ShardStore(spark, path) for _ in range(3))
    a.append(spark.range(3), F.lit(1))
    torn = tmp_path / "s" / "manifest" / "v00000002.json"
    torn.write_text("")
    os.utime(torn, (1, 1))
    both = [x._change(set(), {f"{k}-1": {"path": f"data/{k}/_shard=1", "bytes": 1}}) for k, x in (("a", a), ("b", b))]
    assert [m.version for m in both] == [3, 4] and {"a-1", "b-1"} <= slow.manifest().shards.keys()

    # The slow writer of version 5 creates its claim; before it writes its name, another one passes it over.
    real, done = slow._claim, []

    def passed(version):
        if not done and version == 5:
            done.append(1)
            monkeypatch.setattr(compaction, "LEASE_MS", 0)
            monkeypatch.setattr(a, "_abandoned", lambda v: True)
            done.append(a._change(set(), {"late-1": {"path": "data/late/_shard=1", "bytes": 1}}).version)
        return real(version)

    claimed = slow._claimed

    def slowly(name):
        out = claimed(name)
        passed(5)
        return out

    monkeypatch.setattr(slow, "_claimed", slowly)
    with pytest.raises(compaction.Conflict):
        slow.commit(compaction.Manifest(5, "", 4, {}))
    assert done[1] == 6 and "late-1" in a.manifest().shards and {"a-1", "b-1"} <= a.manifest().shards.keys()


def test_a_claim_finished_late_stops_the_one_that_passed_it(spark, tmp_path, monkeypatch):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(spark.range(3), F.lit(1))
    claim = tmp_path / "s" / "manifest" / "v00000002.json"
    claim.write_text("")
    os.utime(claim, (1, 1))
    real = store._abandoned

    def late(version):
        gone = real(version)
        (tmp_path / "s" / "manifest" / "m00000002-w.json").write_text('{"version": 2, "after": 1, "schema": "", "shards": {}}')
        claim.write_text('{"writer": "w"}')
        return gone

    monkeypatch.setattr(store, "_abandoned", late)
    with pytest.raises(compaction.Conflict):
        store.commit(compaction.Manifest(3, "", 1, {}))
    assert store.manifest().version == 2 and store._claim(3) == ""


def test_vacuum_spares_open_writes(spark, tmp_path, monkeypatch):
    store, other = (compaction.ShardStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    assert store.vacuum() == 0  # a new store
    store.append(spark.range(5), F.lit(1))
    write = store._write

    def with_vacuum(*args):
        out = write(*args)
        assert other.vacuum() == 0
        return out

    monkeypatch.setattr(store, "_write", with_vacuum)
    store.append(spark.range(5), F.lit(2))
    assert store.read().count() == 10 and os.listdir(tmp_path / "s" / "open") == []
    monkeypatch.setattr(store, "_write", write)
    monkeypatch.setattr(store, "_change", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.append(spark.range(7), F.lit(3))
    assert other.vacuum() == 1 and other.read().count() == 10  # of the write that failed


def test_a_race_of_appends_keeps_all_rows(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = f"file://{tmp_path}/s"
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda k: compaction.ShardStore(spark, path).append(spark.range(k, k + 1), F.lit(k)).version, range(6)))
    assert len(set(versions)) == 6
    assert sorted(r.id for r in compaction.ShardStore(spark, path).read().collect()) == list(range(6))


def test_shards_of_the_query_against_the_files(spark, tmp_path, monkeypatch):
    """op8's shard numbers, bytes and version against what lies in the store."""
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 50)) for i in range(400)], "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(queries, "scratch_dir", lambda _: f"file://{tmp_path}")
    got = queries.op8_size_tiered_compaction(spark, str(tmp_path)).collect()
    (root,) = tmp_path.glob("store-*")
    files = {p: sum(f.stat().st_size for f in p.iterdir() if not f.name.startswith(".")) for p in root.glob("data/*/_shard*")}
    names = sorted(files, key=lambda p: f"{p.parent.name}-{p.name.split('=')[1]}")
    want = {}
    for number, p in enumerate(names):
        for r in spark.read.parquet(str(p)).collect():
            want[r.doc_id] = (number, files[p], zlib.crc32(r.text.encode()), len(r.text), 2)
    assert {r.doc_id: (r.shard, r.shard_bytes, r.text_crc32, r.text_bytes, r.version) for r in got} == want and len(want) == 400


def test_compaction_plan_of_many_shards_is_fast():
    sizes = {f"s{i:06d}": 1000 + i % 977 for i in range(60_000)}
    groups = compaction.plan(sizes, least=100, target=1_000_000)
    names = [n for g in groups for n in g]
    assert len(names) == len(set(names)) and len(names) > 59_000
    assert all(sum(sizes[n] for n in g) < 4 * 1_000_000 for g in groups)


# Merkle trees.


def test_merkle_numbers_of_any_size(spark):
    numbers = [-9_000_000_000_000_000_000, -17, -1, 0, 1, 16, (1 << 53) + 1, (1 << 53) + 2, 9_000_000_000_000_000_000]
    df = spark.createDataFrame([(n, f"r{n}") for n in numbers], "number long, record string")
    other = df.where("number not in (-17, 16)").withColumn("record", F.when(F.col("number") == (1 << 53) + 1, "z").otherwise(F.col("record")))
    got = {r.number: r.status for r in merkle.audit(df, other).collect()}
    assert {k: v for k, v in got.items() if v != "ok"} == {-17: "missing", 16: "missing", (1 << 53) + 1: "corrupt"} and set(got) == set(numbers)


def test_merkle_digests_hold_offsets(spark):
    df = spark.createDataFrame([(i, f"record {i}" * 3, 100 * i) for i in range(40)], "number long, record string, offset long")
    assert {r.status for r in merkle.audit(df, df).collect()} == {"ok"}
    other = df.withColumn("offset", F.when(F.col("number") == 20, 2001).otherwise(F.col("offset")))
    got = {r.number: (r.status, r.offset) for r in merkle.audit(df, other).collect()}
    assert got[20] == ("moved", 2000) and [k for k, v in got.items() if v[0] != "ok"] == [20]


def test_merkle_repeated_numbers(spark):
    df = spark.createDataFrame([(7, f"r{i}") for i in range(50)] + [(8, "same"), (8, "same"), (9, None)], "number long, record string")
    assert {r.status for r in merkle.audit(df, df.repartition(9)).collect()} == {"ok"}
    got = {r.number: r.status for r in merkle.audit(df, df.distinct()).collect()}
    assert got == {7: "ok", 8: "corrupt", 9: "ok"}


# PPM by dictionaries, symbol by symbol.


def _symbols(text):
    """(context, symbol) of every coded symbol of a text."""
    tail = b""
    for w in (text or "").encode().lower().split():
        before, own = (tail[-3:] + b" ") if tail else b"\n", w + b" "
        for s in range(len(own)):
            yield ((before + own[:s])[-6:] if s < 3 else (b" " + own[:s])[-6:]), own[s]
        tail = w
    yield ((tail[-3:] + b" ") if tail else b"\n"), 10


class PlainPPM:
    def __init__(self, texts):
        self.counts = [defaultdict(Counter) for _ in range(7)]
        for t in texts:
            for ctx, sym in _symbols(t):
                for k in range(len(ctx) + 1):
                    self.counts[k][ctx[len(ctx) - k :]][sym] += 1
        self.escapes = []
        for k in range(7):
            esc, cases = Counter(), Counter()
            for syms in self.counts[k].values():
                n = sum(syms.values())
                for c in syms.values():
                    if n > 1:
                        at = self.bin(n - 1, len(syms) - (c == 1))
                        cases[at] += c
                        esc[at] += c == 1
            self.escapes.append((esc, cases))

    @staticmethod
    def bin(n, d):
        return min(int(math.log2(max(n, 1))), 17), max(0, min(d if d <= 4 else int(3 + math.log2(d)), 11))

    def escape(self, k, n, d):
        at = self.bin(n, d)
        d_mid = at[1] if at[1] < 5 else 2 ** (at[1] - 2.5)
        prior = min(max(d_mid / (2 * 2 ** (at[0] + 0.5)), 1e-6), 0.5)
        esc, cases = self.escapes[k]
        return min(max((esc[at] + 4 * prior) / (cases[at] + 4), 1e-7), 0.98)

    def score(self, text):
        out = 0.0
        for ctx, sym in _symbols(text):
            gone = {}
            for k in range(len(ctx), -1, -1):
                syms = self.counts[k].get(ctx[len(ctx) - k :], {})
                n, d = sum(syms.values()), len(syms)
                if n == 0 or k and n < ppm_core.TRUST * d:
                    continue
                left_n, left_d = n - sum(syms[s] for s in gone), d - len(gone)
                if left_n > 0:
                    e = self.escape(k, left_n, left_d)
                    if sym in syms:
                        out += math.log10((1 - e) * (syms[sym] - 0.5) / (left_n - 0.5 * left_d))
                        break
                    out += math.log10(e)
                gone = syms
            else:
                out -= math.log10(256 - len(self.counts[0][b""]))
        return out


def test_ppm_scores_against_dictionaries(spark, odd):  # noqa: F811
    out = ppm_scoring.scored(odd, F.col("doc_id") % 3 == 1, chunk_tokens=2_000).collect()
    model = PlainPPM([r[1] for r in odd_rows() if r[0] is None or r[0] % 3 != 1])
    want = defaultdict(list)
    for r in odd_rows():
        want[r[0]].append(model.score(r[1]))
    for r in out:
        assert any(abs(r.score - w) < 1e-4 * abs(w) + 1e-6 for w in want[r.doc_id]), r.doc_id


# Verdicts and networks.


def test_verdicts_are_those_of_the_first_rule(spark, odd):  # noqa: F811
    c = decision_list.Condition
    rules = [(c("mean_word", False, 5.2), c("distinct_share", True, 0.9)), (c("repeat_share", False, 0.01),), (c("upper_share", False, 0.5),)]
    for r in decision_list.with_stats(odd.select("doc_id", "text")).join(decision_list.judged(odd.select("doc_id", "text"), rules).select("doc_id", "rule", "kept", "base_failed").distinct(), "doc_id").collect():
        first = next((k for k, rule in enumerate(rules, 1) if all((r[x.feature] <= x.threshold) == x.at_most for x in rule)), 0)
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert (r.rule, r.base_failed, r.kept) == (first, failed, not failed and first == 0)


def test_convolution_by_loops():
    net, data = byte_cnn.ByteCNN(["a", "b", "c"], seed=3), byte_cnn.windows("Größe und Maß, 日本".encode())[0]
    pooled, at = [], 0
    for w in byte_cnn.WIDTHS:
        for f in range(byte_cnn.FILTERS):
            best = -math.inf
            for i in range(byte_cnn.WINDOW):
                total = 0.0
                for j in range(w):
                    byte = data[i + j] if i + j < len(data) else 0
                    total += float(net.p["emb"][byte] @ net.p["filt"][j * byte_cnn.EMBED : (j + 1) * byte_cnn.EMBED, at + f])
                best = max(best, total)
            pooled.append(max(best + net.p["bias"][at + f], 0))
        at += byte_cnn.FILTERS
    z = np.array(pooled) @ net.p["out"] + net.p["out_b"]
    assert np.allclose(net.log_probs(data[None])[0], z - np.log(np.exp(z).sum()), atol=1e-4)


def test_every_language_can_be_predicted(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(prose(rng, 12).split()), "en") for i in range(400)] + [(1000 + i, "ñandú ción queso zorro " * (3 + i), "rare") for i in range(3)]
    net = byte_cnn.trained(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=50)
    assert net.classes == ["en", "rare"]
    df = spark.createDataFrame([(1, "ción queso ñandú zorro")], "doc_id long, text string")
    assert byte_cnn.with_language(df, net).first().lang_pred == "rare"


def test_pooled_vectors_by_loops():
    rng = np.random.default_rng(2)
    context = rng.normal(size=(quality_net.WORDS, quality_net.DIM)).astype(np.float32)
    v, text = quality_net.Vectors(context), "Some words, some words!\nAND 12 ##"
    words, tokens = quality_net.runs(text), quality_net.Tokens()
    index, shapes = quality_net.index_vectors(quality_net.WORDS, 1), quality_net.index_vectors(quality_net.SHAPES, 2)
    out = np.zeros(2 * quality_net.DIM)
    for w in words:
        number = int(tokens.of([w])[0])
        out += np.concatenate([index[number >> 16] + context[number >> 16], shapes[number & 0xFFFF]]) / len(words)
    assert np.allclose(v.pool(words, tokens), out, atol=1e-5)
    net = quality_net.QualityNet(rng.normal(size=(40, 128)), (np.arange(40) % 2).astype(float))
    x = rng.normal(size=128)
    h = [math.tanh(sum((x[i] - net.mean[i]) / net.std[i] * net.p["a"][i, k] for i in range(128)) + net.p["b"][k]) for k in range(quality_net.HIDDEN)]
    logit = sum(a * b for a, b in zip(h, net.p["c"], strict=True)) + net.p["d"][0]
    assert abs(net.scores(x[None])[0] - 1 / (1 + math.exp(-logit / net.temperature))) < 1e-9


# All entry points over one small table.


@pytest.fixture(scope="module")
def tables(spark, odd, tmp_path_factory):  # noqa: F811
    path = str(tmp_path_factory.mktemp("tables"))
    odd.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join((odd_rows()[8][1]).split()[3:20])), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>") for i in range(120)] + [(None, None, None)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    turns = [(c, t, ("user", "assistant", "system", None)[(c + t) % 4], (None, "", "a.", "b")[t % 4]) for c in range(20) for t in range(6)] + [(None, None, "user", "x.")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    vectors = [(i, [float(i % 7), float(i % 3), i / 10]) for i in range(30)] + [(None, [0.5, 1.0, 2.0]), (31, None), (32, [1.0, None, 2.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_entry_points(spark, tables, name):
    out = queries.queries()[name](spark, tables)
    rows = out.collect()
    assert len(out.columns) == len(set(out.columns))
    docs = Counter(r[0] for r in odd_rows())
    if name.startswith("op4"):
        assert {r.number for r in rows} == set(range(120)) and {r.status for r in rows} == {"ok", "corrupt", "missing"}
    elif name.startswith("op7"):
        assert {(r.doc_id, r.item_id) for r in rows} >= {(8, 1)} and all(100 * r.n_found >= 80 * r.n_shingles for r in rows)
    elif name.startswith("op12"):
        assert Counter(r.conv_id for r in rows) == Counter([*range(20), None]) and all(len(r.repaired_sha256) == 64 for r in rows)
    elif name.startswith("op13"):
        assert Counter(r.vec_id for r in rows) == Counter({**{i: 3 for i in range(30)}, None: 3}) and {r.component for r in rows} == {1, 2, 3}
    elif name.startswith("op9"):
        assert sum(r.doc_tokens for r in rows if r.start == 0) == sum(r.length for r in rows)
        assert Counter(r.doc_id for r in rows if r.start == 0) == docs
    else:
        assert Counter(r.doc_id for r in rows) == docs
    if name.startswith("op8"):
        texts = Counter((r[0], None if r[1] is None else zlib.crc32(r[1].encode())) for r in odd_rows())
        assert Counter((r.doc_id, r.text_crc32) for r in rows) == texts and all(r.shard_bytes > 0 and r.version >= 1 for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_recall_over_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_components(rows, 4, 80)
    got = {r.doc_id: r.component_id for r in queries.op10_minhash_inverted_join(spark, SF).collect()}
    assert got == want


# The pipeline's stages against plain versions on their own inputs.


def test_pipeline_stages_against_plain_versions(spark, odd, tmp_path):  # noqa: F811
    pipeline = pytest.importorskip("corpus_pipeline")
    rng, path = random.Random(31), str(tmp_path)
    base = [prose(rng, 60) for _ in range(40)]
    docs = [(i, t, "en", "k", "s", 1, "z") for i, t in enumerate(base)]
    docs += [(200 + i, base[i], "en", "k", "s", 1, "z") for i in range(8)]  # exact copies
    docs += [(300 + i, base[10 + i] + " more", "en", "k", "s", 1, "z") for i in range(5)]  # near ones
    docs += [(5, base[30] + " tail", "en", "k", "s", 1, "z"), (7, base[7], "en", "other", "s", 1, "z"), (7, base[7].upper(), "en", "k", "s", 1, "z"), (None, base[9], "en", "k", "s", 1, "z"), (None, prose(rng, 60), "en", "k", "s", 1, "z")]
    item = " ".join(base[20].split()[10:30])
    spark.createDataFrame([(1, item), (2, None), (None, " ".join(base[21].split()[:8]))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    df = spark.createDataFrame(docs, SCHEMA).unionByName(odd)
    rows = [tuple(r) for r in df.collect()]

    kept = [tuple(r) for r in pipeline.near_dedup(spark, df, path).collect()]
    # Plain: components over (id, text) pairs; the least id's rows of a component stay, one row of each id.
    keys = sorted({(r[0], r[1]) for r in rows}, key=lambda k: (k[0] is None, k[0] or 0, k[1] or ""))
    comp = brute_components([(i, t) for i, (_, t) in enumerate(keys)], 5, 80)
    groups = defaultdict(list)
    for i, k in enumerate(keys):
        groups[comp[i]].append(k)
    assert len({r[:2] for r in kept}) == len(kept)
    for members in groups.values():
        here = [k for k in kept if k[:2] in members]
        if not (members[0][1] or "").split():
            assert len(here) == len({k for k in members})
        else:
            assert len(here) == 1 and here[0][0] == members[0][0]
    assert all(k in rows for k in kept)
    assert Counter(kept) == Counter(tuple(r) for r in pipeline.near_dedup(spark, df.repartition(5), path).collect())

    held = [set(zip(*(w[j:] for j in range(5)), strict=False)) for w in [item.lower().split(), base[21].lower().split()[:8]]]
    leaks = lambda t: any(100 * len(h & set(zip(*((t or "").lower().split()[j:] for j in range(5)), strict=False))) >= 80 * len(h) for h in held)
    assert Counter(tuple(r) for r in pipeline.decontamination(spark, df, path).collect()) == Counter(r for r in rows if not leaks(r[1]))

    spark.createDataFrame([(i, int(i < 25), 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    rules = decision_list.learned_from(df, spark.read.parquet(f"{path}/labels.parquet"))
    verdicts = {r.text: r.kept for r in decision_list.judged(df.select("text"), rules).collect()}
    assert Counter(tuple(r) for r in pipeline.quality_rules(spark, df, path).collect()) == Counter(r for r in rows if verdicts[r[1]])
    named = {r.text: (r.lang_pred, r.score) for r in byte_cnn.with_language(df.select("text"), byte_cnn.trained(df)).collect()}
    assert Counter(tuple(r) for r in pipeline.language(spark, df, path).collect()) == Counter(r for r in rows if named[r[1]][0] != "und" and named[r[1]][1] >= 0.5)


def test_pipeline_over_empty_tables(spark, odd, tmp_path):  # noqa: F811
    pipeline = pytest.importorskip("corpus_pipeline")
    path = str(tmp_path)
    odd.limit(0).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert pipeline.run(spark, path).count() == 0


def test_ppm_arrays_against_plain_words():
    words = [b"a", b"ab", b"abc", b"abcd", "größe".encode(), b"\x00\xff", b"x" * 40]
    joined = b" ".join(words)
    heads, tails = ppm_scoring.word_ends(ppm_scoring._blob(joined))
    for w, h, t in zip(words, heads.tolist(), tails.tolist(), strict=True):
        head, tail = (w + b" ")[:3], w[-3:]
        assert h == int.from_bytes(head, "little") | len(head) << 24
        assert t == int.from_bytes(tail, "big") | len(tail) << 24
    grams, owner = ppm_scoring.inner_grams(words)
    plain = []
    for i, w in enumerate(words):
        s = b" " + w + b" "
        for at in range(4, len(s)):
            k = min(at, 6)
            plain.append((int.from_bytes(s[at - k : at + 1], "big") | k << 56, i))
    assert list(zip(grams.tolist(), owner.tolist(), strict=True)) == plain
    assert ppm_scoring._words(joined).to_pylist() == words
    for x in ([], [0], [7, 2**63, 7, 0]):
        x = np.array(x, np.uint64)
        assert ppm_scoring._unpack(ppm_scoring._pack(x)).tolist() == x.tolist()
        values, at = ppm_scoring._distinct(x)
        assert values.tolist() == sorted(set(x.tolist())) and values[at].tolist() == x.tolist()
    assert [len(x) for x in ppm_scoring._blob(b"")] == [0, 0, 0] and len(ppm_scoring.inner_grams([])[0]) == 0
