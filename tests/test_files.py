"""One file for each row, and pages fetched from a server of the test's own."""

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from notes_engine.functions import urls
from notes_engine.sources import fetched, files


def found(root):
    return {str(p.relative_to(root)): p.read_bytes().decode() for p in root.rglob("*") if p.is_file()}


def test_files(spark, tmp_path):
    rows = [(f"s{i}/a b/{n}", f"é{i}\nx") for i in range(40) for n in ("content.md", "README.md")] + [("empty.md", None)]
    files.write(spark.createDataFrame(rows, "path string, text string").repartition(5), str(tmp_path))
    assert found(tmp_path) == {p: t or "" for p, t in rows}
    files.write(spark.createDataFrame([("empty.md", "now"), ("new.md", "n")], "path string, text string"), f"file://{tmp_path}")
    assert found(tmp_path) == {**{p: t or "" for p, t in rows}, "empty.md": "now", "new.md": "n"}
    back = {r.path: r.text for r in files.read(spark, str(tmp_path)).collect()}
    assert back["s7/a b/content.md"] == "é7\nx" and back["empty.md"] == "now"


@pytest.mark.parametrize("bad", ["../up.md", "/abs.md", "", None, "a/../../b", "_temporary/x"])
def test_a_failed_write_leaves_nothing(spark, tmp_path, bad):
    rows = [(f"{i}.md", "x") for i in range(20)] + [(bad, "x")]
    with pytest.raises(Exception, match="below the target"):
        files.write(spark.createDataFrame(rows, "path string, text string").repartition(4), str(tmp_path))
    assert found(tmp_path) == {} and not list(tmp_path.iterdir())


def test_two_rows_of_one_path_and_files_that_are_there(spark, tmp_path):
    with pytest.raises(Exception, match="two rows"):
        files.write(spark.createDataFrame([("a.md", "x"), ("./a.md", "y")], "path string, text string"), str(tmp_path))
    assert found(tmp_path) == {}
    one = spark.createDataFrame([("a.md", "x")], "path string, text string")
    files.write(one, str(tmp_path), overwrite=False)
    with pytest.raises(Exception, match="FileExistsError"):
        files.write(one.unionByName(spark.createDataFrame([("b.md", "y")], "path string, text string")), str(tmp_path), overwrite=False)
    assert found(tmp_path) == {"a.md": "x"}


def test_files_of_sources(spark, tmp_path):
    r = spark.createDataFrame([("My  Talk: 1/2?", "c", "s", "r"), ("…", "c2", None, "r2")], "title string, content string, summary string, readme string")
    u = spark.createDataFrame([("My  Talk: 1/2?", "md", "{}", "2024-05-06 07:08:09")], "title string, report string, json_report string, at string")
    files.write(files.rendered_files(r, files.folder_name(F.col("title"))).unionByName(files.usage_files(u, files.folder_name(F.col("title")), F.to_timestamp("at"))), str(tmp_path))
    assert found(tmp_path) == {
        "My_Talk_1_2/content.md": "c", "My_Talk_1_2/summary.md": "s", "My_Talk_1_2/README.md": "r", "untitled/content.md": "c2", "untitled/README.md": "r2",
        "My_Talk_1_2/llm_usage_20240506_070809.md": "md", "My_Talk_1_2/llm_usage_20240506_070809.json": "{}"}


@pytest.fixture(scope="module")
def server():
    seen = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            n = seen[self.path] = seen.get(self.path, 0) + 1
            moved = {"/from": "/mid", "/mid": "ok?x=1", "/out": "http://10.0.0.8/", "/loop": "/loop"}.get(self.path)
            status = 302 if moved else 404 if self.path == "/gone" else 503 if self.path == "/busy" or self.path == "/once" and n == 1 else 200
            body = {"/latin": "café".encode("latin-1"), "/blank": b" "}.get(self.path, f"<p>{self.path}</p>".encode())
            self.send_response(status)
            if moved:
                self.send_header("Location", moved)
            self.send_header("Content-Type", {"/pdf": "application/pdf", "/latin": "text/html; charset=ISO-8859-1"}.get(self.path, "Text/HTML"))
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_fetched(spark, server):
    base, seen = server
    names = ["ok", "from", "out", "loop", "gone", "busy", "once", "latin", "blank", "pdf", "ok"]
    here = lambda u: F.when(u.startswith(base), None).otherwise(urls.refusal(u))
    df = spark.createDataFrame([(f"{base}/{n}", 1) for n in names] + [("ftp://x/y", 2), ("http://localhost/", 3), (None, 4)], "url string, attempts int")
    out = {(r.url or "").removeprefix(f"{base}/"): r for r in fetched.fetched(df, hops=3, refusal=here, wait=0.01, timeout=5).collect()}
    assert len(out) == 12
    assert (out["ok"].body, out["ok"].problem, out["ok"].redirects) == ("<p>/ok</p>", None, 0)
    assert (out["from"].body, out["from"].final_url, out["from"].redirects) == ("<p>/ok?x=1</p>", f"{base}/ok?x=1", 2)
    assert (out["once"].attempts, out["once"].body) == (2, "<p>/once</p>") and seen["/once"] == 2 and seen["/ok"] == 1 and seen["/loop"] == 4
    assert out["latin"].body == "café"
    assert {k: r.problem for k, r in out.items() if r.problem} == {
        "out": "refused: private", "loop": "redirects", "gone": "status: 404", "busy": "status: 503", "blank": "empty", "pdf": "content type: application/pdf",
        "ftp://x/y": "refused: scheme", "http://localhost/": "refused: local"}
    assert out["busy"].attempts == 3 and all(r.body is None for r in out.values() if r.problem)


def test_no_server_and_no_addresses(spark):
    df = spark.createDataFrame([("http://127.0.0.1:9/",)], "url string")
    (one,) = fetched.fetched(df, refusal=lambda u: F.lit(None).cast("string"), attempts=2, wait=0.01, timeout=2).collect()
    assert (one.problem, one.attempts, one.waited) == ("network", 2, 1)
    assert fetched.fetched(df.limit(0)).count() == 0
