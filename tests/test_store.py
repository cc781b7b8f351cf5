import datetime
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tesserae.operators import store
from tesserae.sources import base, files
from tesserae.streaming import ingest
from tesserae.warehouse import Append, Change, Conflict, Segment, Warehouse, full_tier

DOC = "id long, source_collection_id long, path string, title string, hash string, active boolean, modified_at string"


def test_upserts(spark):
    stored = spark.createDataFrame([(1, 1, "a", "A", "h1", False, "t0"), (2, 1, "b", "B", "h2", True, "t0")], DOC)
    new = spark.createDataFrame([(1, "a", "A2", "h3", "t1"), (1, "c", "C", "h4", "t1"), (2, "a", "Z", "h5", "t1")], "source_collection_id long, path string, title string, hash string, modified_at string")
    got = {(r["source_collection_id"], r["path"]): r for r in store.upsert_documents(stored, new).collect()}
    assert got[1, "a"]["active"] and got[1, "a"]["hash"] == "h3" and got[1, "a"]["id"] == 1 and not got[1, "a"]["is_new"]
    twice = new.union(spark.createDataFrame([(1, "c", "C2", "h6", "t2")], new.schema))
    assert {(r["path"], r["hash"]) for r in store.upsert_documents(stored, twice).where("path = 'c'").collect()} == {("c", "h6")}
    assert got[1, "c"]["is_new"] and got[2, "a"]["is_new"] and len({r["id"] for r in got.values()}) == 4
    content = spark.createDataFrame([("h1", "x")], "hash string, doc string")
    assert store.upsert_content(content, spark.createDataFrame([("h1", "y"), ("h2", "z"), ("h2", "z")], "hash string, doc string")).count() == 2
    gone = store.soft_delete(stored, stored.where("path = 'b'"))
    assert {r["path"]: r["active"] for r in gone.collect()} == {"a": False, "b": False}
    left, kept = store.remove_collection(stored, content, 1)
    assert left.count() == 0 and kept.count() == 0


def test_replace_rows(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert {tuple(r) for r in store.replace_rows(old, spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string"), ["id"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}


PATHS = ("a.md", "d/b.md", "d/e/c.md", "d/x.txt", "drafts/f/g.md")


@pytest.mark.parametrize(
    ("patterns", "fits", "listed"),
    [
        (["**/*.md"], {"a.md", "d/b.md", "d/e/c.md", "drafts/f/g.md"}, {"a.md", "d/b.md", "d/e/c.md", "drafts/f/g.md"}),
        (["*.md"], {"a.md", "d/b.md", "d/e/c.md", "drafts/f/g.md"}, {"a.md"}),
        (["d/**"], {"d/b.md", "d/x.txt"}, {"d/b.md", "d/e/c.md", "d/x.txt"}),
        (["**/*", "!**/drafts/**", "!e/*"], {"a.md", "d/b.md", "d/x.txt"}, {"a.md", "d/b.md", "d/x.txt"}),
        (["?.md"], {"a.md", "d/b.md", "d/e/c.md", "drafts/f/g.md"}, {"a.md"}),
    ],
)
def test_globs(spark, patterns, fits, listed):
    paths = spark.createDataFrame([(p,) for p in PATHS], "path string")
    taken = lambda c: {r["path"] for r in paths.where(c).collect()}
    assert taken(files.matches_patterns(F.col("path"), patterns)) == fits and taken(files.lists_patterns(F.col("path"), patterns)) == listed


def test_patterns():
    assert files.parse_patterns(None) == ["**/*.md"] and files.parse_patterns("") == [""]
    with pytest.raises(ValueError):
        files.split_patterns(["!x"])


def test_read_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.md").write_bytes(b"x\r\ny")
    (tmp_path / "d" / "b.md").write_bytes(b"\xff\xfe")
    (tmp_path / "d" / "skip.txt").write_text("t")
    got = {r["path"]: r for r in files.read_files(spark, str(tmp_path), ["**/*.md"]).collect()}
    assert set(got) == {"a.md", "d/b.md"} and got["a.md"]["text"] == "x\ny" and got["a.md"]["content_type"] == "text/markdown"
    assert got["d/b.md"]["text"] is None and got["d/b.md"]["error"]
    (tmp_path / "l.md").symlink_to(tmp_path / "a.md")
    paths = lambda **o: {r["path"] for r in files.read_files(spark, str(tmp_path), **o).collect()}
    assert paths() == {"a.md", "d/b.md"} and paths(follow_symlinks=True) == {"a.md", "d/b.md", "l.md"}
    (tmp_path / "d" / "with space+é.md").write_bytes("é".encode("latin-1"))
    (tmp_path / ".hidden.md").write_text("h")
    assert files.read_files(spark, str(tmp_path), ["d/with*"], encoding="ISO-8859-1").first()["text"] == "é"
    named = lambda **o: {r["path"] for r in files.read_directory(spark, str(tmp_path), **o).collect()}
    assert named(suffixes=[".TXT"]) == {"d/skip.txt"} and named(recursive=False) == {"a.md", ".hidden.md"}
    with pytest.raises(FileNotFoundError):
        files.read_files(spark, str(tmp_path / "none"))
    with pytest.raises(NotADirectoryError):
        files.read_files(spark, str(tmp_path / "a.md"))


def test_web(spark, tmp_path):
    (tmp_path / "p.html").write_text("<head>x</head><p>One <b>two</b></p><script>y</script>")
    got = {r["error"] is None: r for r in files.read_web(spark, [f"file://{tmp_path}/p.html", f"file://{tmp_path}/none"]).collect()}
    assert got[True]["text"] == "One two" and got[False]["text"] is None


def test_web_tells_of_the_fetch(spark):
    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/a" else 404)
            self.send_header("ETag", '"v1"')
            self.send_header("Last-Modified", "Wed, 21 Feb 2024 07:28:00 GMT")
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(b"<p>text</p>")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base_uri = f"http://127.0.0.1:{server.server_port}"
    got = {r["uri"].rsplit("/", 1)[1]: r for r in base.WebSource(spark, [f"{base_uri}/a", f"{base_uri}/b"]).read().collect()}
    server.shutdown()
    a = got["a"]
    assert (a["text"], a["etag"], a["http_status"], a["content_type"], a["mtime"], a["error"]) == ("text", '"v1"', 200, "text/html", datetime.datetime(2024, 2, 21, 7, 28), None) and a["fetch_duration_ms"] >= 0
    assert got["b"]["http_status"] == 404 and got["b"]["text"] is None and got["b"]["error"]


def test_loader(spark):
    class Doc:
        def __init__(self, text, **meta):
            self.text, self.metadata = text, meta

    class Loader:
        def __init__(self, *docs):
            self.docs = docs

        def load_data(self):
            return self.docs

    rows = files.read_loader(spark, Loader(Doc("x", path="p"), Doc("y", uri="u"))).collect()
    assert rows[0]["uri"].startswith("hash-") and rows[0]["path"] == "p" and rows[1]["uri"] == "u" and rows[1]["path"] == "doc-1"
    with pytest.raises(ValueError):
        files.read_loader(spark, Loader(Doc("x", uri="u"), Doc("y", uri="u")))
    with pytest.raises(ValueError):
        files.read_loader(spark, Loader(Doc("x"), Doc("y")), allow_multiple=False)
    titled = files.read_loader(spark, Loader(Doc("# Head\nx", k=1), Doc("y", title="T"), Doc("z", path="p"))).collect()
    assert [r["title"] for r in titled] == ["Head", "T", "p"] and titled[0]["extra"] == {"k": "1"}
    kinds = base.SourceRegistry()
    with pytest.raises(ValueError):
        kinds.create("ftp", spark, "x")
    source = base.LoaderSource(spark, Loader(Doc("x", path="p")))
    assert source.read().columns == list(base.COLUMNS) and source.check_modified(spark.createDataFrame([], "path string, mtime timestamp")).first()["touched"]


def test_settings(spark, tmp_path):
    s = base.Settings.of("file:///a%20b", {"glob_pattern": "*.txt", "follow_symlinks": "true"})
    assert s.root == "/a b" and s.patterns == ("*.txt",) and s.follow_symlinks
    assert base.Settings.of("/x", {"glob_patterns": "*.a\n!b"}).patterns == ("*.a", "!b") and base.Settings.of("/x").patterns == ("**/*.md",)
    (tmp_path / "a.md").write_text("x")
    source = base.SourceRegistry().create("filesystem", spark, f"file://{tmp_path}")
    now = source.listing().select("path", "mtime")
    assert source.capabilities.last_modified and not source.check_modified(now).first()["touched"]
    assert {r["path"]: r["touched"] for r in source.check_modified(spark.createDataFrame([("gone.md", None)], "path string, mtime timestamp")).collect()} == {"gone.md": True, "a.md": True}


def test_cache(spark, tmp_path):
    rows = spark.createDataFrame([("d/a.md", "x"), ("d/e/b.md", "y"), ("c.md", None)], "path string, text string")
    uris = {r["path"]: r["uri"] for r in store.cache_documents(rows, str(tmp_path), "col").collect()}
    assert uris["d/a.md"] == f"file://{tmp_path}/col/d/a.md" and (tmp_path / "col/d/e/b.md").read_text() == "y"
    assert store.uncache_documents(spark, str(tmp_path), "col", ["d/e/b.md", "none"]) == 1 and not (tmp_path / "col/d/e").exists()
    assert store.uncache_documents(spark, str(tmp_path), "col") == 2 and store.uncache_documents(spark, str(tmp_path), "col") == 0
    with pytest.raises(Exception, match="leaves the cache"):
        store.cache_documents(spark.createDataFrame([("../../x", "y")], "path string, text string"), str(tmp_path), "col").collect()


def test_warehouse(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    assert w.versions() == [] and w.read("content").count() == 0
    row = lambda h: spark.createDataFrame([(h, "d", None)], w.read("content").schema)
    assert w.commit({"content": row("a")}) == 1 and w.commit({"lengths": Append(spark.createDataFrame([(1, 2)], "doc_id long, dl int"))}) == 2
    assert w.read("content").first()["hash"] == "a" and w.read("lengths").count() == 1 and w.read("lengths", 1).count() == 0
    other = Warehouse(spark, w.root)
    real, other._pointer = other._pointer, lambda v=None: (1, {})  # a writer that has seen version 1 alone
    with pytest.raises(Conflict):
        other.commit({"content": row("b")})
    other._pointer = real
    assert w.read("content").first()["hash"] == "a" and w.vacuum() == 0 and w.vacuum(least_age=0.0) == 1 and w.read("content").count() == 1
    assert w.sql("SELECT hash FROM content WHERE hash = ?", ["a"]).count() == 1


def test_writers_at_once_and_dead_ones(spark, tmp_path):
    """Of writers that commit at once one wins; a pointer that is half written is no version, blocks
    writers, and goes with a vacuum."""
    w = Warehouse(spark, str(tmp_path / "w"))
    row = lambda h: spark.createDataFrame([(h, "d", None)], w.read("content").schema)
    w.commit({"content": row("a")})
    base = w._pointer()
    told = []

    def write(h):
        mine = Warehouse(spark, w.root)
        mine._pointer = lambda v=None: base
        try:
            told.append(mine.commit({"content": row(h)}))
        except Conflict:
            told.append(None)

    threads = [threading.Thread(target=write, args=(h,)) for h in "bcd"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(told, key=str) == [2, None, None] and w.read("content").count() == 1
    (tmp_path / "w/_versions/000000000003.json").write_text('{"content"')
    assert w._pointer()[0] == 2 and w.read("content").count() == 1
    with pytest.raises(Conflict):
        w.commit({"content": row("e")})
    w.vacuum()
    assert 3 in w.versions()
    w.vacuum(least_age=0.0)
    assert 3 not in w.versions() and w.commit({"content": row("e")}) == 3


def test_touched_buckets(spark, tmp_path):
    """A change replaces the buckets of its keys and no others; keys that come twice are one row; a
    change of nothing writes nothing; large buckets are dealt into more."""
    w = Warehouse(spark, str(tmp_path / "w"), buckets=16)
    row = "document_id long, profile string, tags array<string>, source_tags array<string>, attributes string, extracted_at timestamp_ntz"
    at = lambda n, p="p", day=1: (n, p, [], [], "{}", datetime.datetime(2024, 1, day))
    made = lambda *rows: spark.createDataFrame(list(rows), row)
    change = lambda rows, gone=None: Change(["document_id"], rows, gone, ["extracted_at"])
    w.commit({"document_metadata": change(made(*map(at, range(200))))})
    before = set(w.folders("document_metadata"))
    assert 12 < len(before) <= 16
    w.commit({"document_metadata": change(made(at(3, "old", 2), at(3, "new", 3), at(900)), made(at(7)).select("document_id"))})
    after = set(w.folders("document_metadata"))
    assert 1 <= len(before - after) <= 3 and len(before & after) >= 9
    got = {r["document_id"]: r["profile"] for r in w.read("document_metadata").collect()}
    assert len(got) == w.read("document_metadata").count() == 200 and got[3] == "new" and 7 not in got and 900 in got
    version = w.versions()
    assert w.commit({"document_metadata": change(made())}) == version[-1] and w.versions() == version
    w.commit({"document_metadata": change(None, w.read("document_metadata").select("document_id"))})
    assert w.read("document_metadata").count() == 0 and w.folders("document_metadata") == []
    small_ones = Warehouse(spark, str(tmp_path / "v"), buckets=2, bucket_bytes=1)
    small_ones.commit({"document_metadata": change(made(*map(at, range(50))))})
    small_ones.commit({"document_metadata": change(made(at(1)))})
    assert small_ones._pointer()[1]["document_metadata"]["count"] == 8 and small_ones.read("document_metadata").count() == 50


def test_tiers():
    seg = lambda n, size: Segment(n, "f", size)
    few = [seg(1, 5 << 20), seg(2, 10), seg(3, 100), seg(4, 1 << 19)]
    assert full_tier(few, 4) == [] and full_tier([*few, seg(5, 1)], 4) == [*few[1:], seg(5, 1)]
    assert full_tier([seg(i, 5 << 20) for i in range(4)] + few[1:3], 4) == [seg(i, 5 << 20) for i in range(4)]


def test_changes(spark):
    stored = spark.createDataFrame([(1, "a"), (None, "n"), (2, "b")], "id long, v string")
    rows = spark.createDataFrame([(2, "c"), (2, "d"), (None, "m")], "id long, v string")
    gone = spark.createDataFrame([(1,)], "id long")
    kept = lambda **o: {tuple(r) for r in store.apply_change(stored, ["id"], rows, **o).collect()}
    assert kept(gone=gone, order=["v"]) == {(2, "d"), (None, "m")} and kept() == {(1, "a"), (2, "c"), (2, "d"), (None, "m")}
    assert store.replace_rows(stored, rows, ["id"]).count() == 3


def test_tree(spark, tmp_path):
    """Every file below a folder, hidden names too, over more folders than the driver descends to."""
    from tesserae.sources import tree

    want = set()
    for i in range(90):
        for name in (f"d{i}/x.md", f"d{i}/.h/y", f"_e/f{i}/z.md"):
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_text(name)
            want.add(name)
    (tmp_path / "loop").symlink_to(tmp_path)
    rows = tree.listing(spark, str(tmp_path))
    assert {r["path"] for r in rows.collect()} == want and rows.rdd.getNumPartitions() >= 64
    assert {r["path"] for r in tree.listing(spark, f"file://{tmp_path}", follow_symlinks=True).collect()} == want
    got = tree.fetch(rows.where("path LIKE 'd1%'").unionByName(spark.createDataFrame([("file:///none", "none", 1, None, False)], rows.schema))).collect()
    assert all((bytes(r["content"]).decode() == r["path"]) if r["failure"] is None else r["path"] == "none" for r in got) and sum(r["failure"] is not None for r in got) == 1


def test_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(source)
    run = lambda: ingest.ingest_stream(spark, source, "doc_id long, text string", str(tmp_path / "ck"), lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}")).awaitTermination()
    run()
    spark.createDataFrame([(3, "c")], "doc_id long, text string").write.mode("append").parquet(source)
    run()
    got = spark.read.parquet(out)
    assert {r["doc_id"] for r in got.collect()} == {1, 2, 3} and got.where("batch = 1").count() == 1
