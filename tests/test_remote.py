"""Network sources against a server in this process, and incremental maintenance from a landing directory."""

import io
import json
import threading
import zipfile
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from plugscope.plans import analyze as A
from plugscope.sources import corpus, remote
from plugscope.streaming import incremental


def archive(slug):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr(f"{slug}/{slug}.php", f"<?php\n/*\n * Plugin Name: {slug}\n */\nadd_action('wp_ajax_nopriv_{slug}', 'f');")
        z.writestr(f"{slug}/../../evil.php", "<?php")
    return held.getvalue()


@pytest.fixture(scope="module")
def server():
    asked = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            kind, _, name = self.path.strip("/").partition("/")
            code, body = 200, b""
            if kind == "pages":
                body = f'<a href="/plugins/p{name}a/">x</a><a href="/plugins/shared/">y</a><a href="/plugins/browse/">b</a><a href="/page/3/">3</a>'.encode()
                code = 503 if asked[self.path] == 1 and name == "2" else 200
            elif kind == "info":
                code = 404 if name == "p1a" else 200
                body = json.dumps({"slug": name, "download_link": f"http://127.0.0.1:{self.server.server_address[1]}/zip/{name}", "author": False}).encode()
            elif kind == "zip":
                code = 500 if name == "p3a" else 200
                body = archive(name)
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body if code == 200 else b"no")

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}", asked
    s.shutdown()


def test_pages_source(spark, server):
    url, asked = server
    spark.dataSource.register(remote.PagesSource)
    read = lambda **o: spark.read.format("http_pages").options(url=f"{url}/pages/{{page}}", base=0, **o).load()
    assert read().rdd.getNumPartitions() == 3
    rows = {r["page"]: r for r in read(pages=2).collect()}
    assert sorted(rows) == [1, 2] and rows[1]["attempts"] == 1 and rows[2]["status"] == 200
    assert read(max_pages=1).count() == 1
    gone = spark.read.format("http_pages").options(url="http://127.0.0.1:1/{page}", pages=1, attempts=2, base=0).load().first()
    assert gone["body"] is None and gone["attempts"] == 2 and gone["error"]


def test_full_run(spark, server):
    url, asked = server
    client = remote.Client(attempts=2, base=0)
    done, got = A.run(spark, f"{url}/pages/{{page}}", f"{url}/info/{{slug}}", client=client)
    assert {r["plugin_slug"]: r["error"] for r in got.collect()} == {"shared": None, "p2a": None, "p3a": "status 500"}
    assert sorted(r["route"][-6:] for r in done.endpoints.collect()) == ["n=p2a", "shared"] or done.endpoints.count() == 2
    assert {r["plugin_slug"] for r in done.plugins.collect()} == {"shared", "p2a"}
    assert asked["/zip/p2a"] == 1 and asked["/info/p1a"] == 1


def test_failures_are_replaced_in_order(spark, server):
    url, _ = server
    slugs = spark.createDataFrame([("p1a", 0), ("shared", 1), ("p2a", 2), ("p3a", 3)], "slug string, pos int")
    client = remote.Client(attempts=1, base=0)
    got = remote.details(slugs, f"{url}/info/{{slug}}", 2, client, wave=1)
    assert [(r["slug"], r["pos"]) for r in got.orderBy("pos").collect()] == [("shared", 1), ("p2a", 2)]
    assert remote.details(slugs.limit(0), f"{url}/info/{{slug}}", 2, client).collect() == []
    with pytest.raises(ValueError):
        remote.details(slugs, url, -1)
    with pytest.raises(ValueError):
        corpus.popular(slugs, -1)


def test_fetch_keeps_columns(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "nonsense://y", "z")], "k int, url string, status string")
    got = {r["k"]: r for r in remote.fetch(rows, remote.Client(attempts=1, base=0)).collect()}
    assert got[1]["error"] == "no url" and got[1]["attempts"] == 0
    assert got[2]["body"] is None and got[2]["error"]


def drop(root, number, files):
    for name, text in files.items():
        path = root / str(number) / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())


def test_landing_directory(spark, tmp_path):
    """Changed, emptied, removed and repeated plugins end equal to a full run over what is left."""
    root, table, state = tmp_path / "drops", str(tmp_path / "now"), str(tmp_path / "state")
    code = lambda n: f"<?php add_action('wp_ajax_nopriv_{n}', 'f');"
    turns = [
        {"a/main.php": code("a1"), "b/main.php": code("b1"), "b/more.php": code("b2"), "c/main.php": code("c1"), "d/x.php": code("d1")},
        {"a/main.php": "<?php echo 1;", "b/more.php.deleted": "x", "c.deleted": "x", "d/x.php": code("d1")},
        {"c/new.php": code("c2"), "b/main.php": code("b3")},
    ]
    want = [{"a1", "b1", "b2", "c1", "d1"}, {"b1", "d1"}, {"b3", "c2", "d1"}]
    for number, (files, names) in enumerate(zip(turns, want), 1):
        drop(root, number, files)
        incremental.maintain(incremental.landing(spark, str(root)), table, state).awaitTermination()
        got = incremental.endpoints(spark, f"{table}/endpoints")
        assert {r["route"].rpartition("=")[2] for r in got.collect()} == names
    left = incremental.files(spark, f"{table}/files")
    assert {(r["plugin_slug"], r["file"]) for r in left.collect()} == {("a", "main.php"), ("b", "main.php"), ("c", "new.php"), ("d", "x.php")}
    full = A.analyze(left).endpoints
    columns = ["plugin_slug", "route", "method", "auth_level", "callback"]
    assert sorted(map(tuple, full.select(columns).collect())) == sorted(map(tuple, incremental.endpoints(spark, f"{table}/endpoints").select(columns).collect()))


def test_state_follows_drops():
    import pandas as pd

    class State:
        def __init__(self, value=None):
            self.value = value

        exists = property(lambda s: s.value is not None)
        get = property(lambda s: s.value)

        def update(self, value):
            self.value = value

        def remove(self):
            self.value = None

    def track(state, *rows):
        out = list(incremental._track(("p",), iter([pd.DataFrame(rows, columns=["drop", "file", "content", "deleted"])]), state))
        return sorted((r.file, r.content, r.deleted) for r in out[0].itertuples()) if out else []

    state = State()
    assert track(state, (2, "a", b"new", False), (1, "a", b"old", False)) == [("a", b"new", False)]
    assert track(state, (3, "a", b"new", False)) == []
    assert track(state, (4, "b", b"x", False), (4, "a", None, True)) == [("a", None, True), ("b", b"x", False)]
    assert track(state, (5, "", None, True), (6, "b", b"x", False)) == []  # removed and dropped again as it was
    assert track(state, (7, "", None, True)) == [("b", None, True)] and not state.exists
