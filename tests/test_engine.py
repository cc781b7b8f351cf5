"""The engine end to end over folders: collections, ingestion, embedding, search, upkeep."""

import datetime
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae import __main__ as cli
from tesserae.engine import Engine
from tesserae.functions import providers, tracing
from tesserae.operators import collections, fulltext, index, tags, vectors
from tesserae.streaming import ingest


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    (d / "sub").mkdir(parents=True)
    (d / "a.md").write_text("# Rank fusion\n\nRunning lists are fused by reciprocal ranks. #search/fusion")
    (d / "sub" / "b.md").write_text("---\ntags: [cooking]\n---\nA recipe for soup with beans.")
    (d / "c.md").write_text("# only a heading")
    (d / "bad.md").write_bytes(b"\xff\xfe\xfa")
    return d


def test_life_of_a_collection(spark, folder, tmp_path):
    e = Engine(spark, str(tmp_path / "w"))
    e.config = e.config.__class__(cache_dir=str(tmp_path / "cache"))
    e.add_collection("notes", str(folder))
    with pytest.raises(collections.Exists):
        e.add_collection("notes", "/x")
    assert e.ingest("notes") == {"indexed": 3, "skipped": 0, "errors": 1, "stale": 0}
    docs = {r["path"]: r for r in e.table("documents").collect()}
    assert docs["a.md"]["title"] == "Rank fusion" and docs["sub/b.md"]["title"] == "b" and docs["a.md"]["content_type"] == "text/markdown" and docs["a.md"]["last_fetched_at"]
    assert e.table("lengths").count() == 2  # a lone heading is not indexed
    assert {r["tag"] for r in e.table("document_tags").collect()} == {"search", "search/fusion", "cooking"}
    assert (tmp_path / "cache/notes/sub/b.md").exists()
    again = e.ingest("notes")
    assert again == {"indexed": 0, "skipped": 3, "errors": 1, "stale": 0}
    assert e.embed("notes") == {"embedded": 2, "skipped": 0, "chunks": 2} and e.embed() == {"embedded": 0, "skipped": 2, "chunks": 0}
    assert e.embed(force=True)["embedded"] == 2 and e.table("content_vectors").count() == 2
    files = lambda df: [r["file"] for r in df.collect()]
    assert files(e.fts_search("run")) == ["a.md"] and files(e.fts_search("soup OR fusion")) == files(e.fts_search("soup OR fusion", collection="nobody"))
    assert files(e.vector_search("recipe soup beans"))[0] == "sub/b.md"
    found = e.query("cooking OR beans", rerank=True).collect()
    assert found[0]["file"] == "sub/b.md" and found[0]["tag_rank"] == 0
    with pytest.raises(ValueError):
        e.query('"open')
    assert e.passages(["soup", "beans"])[0]["file"] == "sub/b.md" and e.answer("soup")["sources"][0] == "b"
    status = e.status()
    assert (status["collections"], status["documents"], status["embedded"], status["indexed"]) == (1, 3, 2, 2)
    report = {r["issue"]: r for r in e.sync_report().collect()}
    assert report["missing_fts"]["samples"] == ["c.md"] and report["orphan_fts"]["n"] == 0
    (folder / "a.md").unlink()
    (folder / "sub" / "b.md").write_text("A recipe for bread.")
    assert e.ingest("notes") == {"indexed": 1, "skipped": 1, "errors": 1, "stale": 1}
    assert files(e.fts_search("fusion OR bread OR soup")) == ["sub/b.md"] and not (tmp_path / "cache/notes/a.md").exists()
    assert e.table("documents").where("active").count() == 2 and e.sql("SELECT count(*) AS n FROM documents WHERE active = ?", [False]).first()["n"] == 1
    assert e.cleanup()["content"] == 2 and e.cleanup()["content"] == 0
    assert e.backfill() == {"processed": 0, "updated": 0, "skipped": 0} and e.backfill("notes", force=True)["updated"] == 2
    assert e.reindex("notes") == 2 and e.live_index.live_lengths.count() == 2 and e.sql("SELECT doc_id FROM lengths").count() == 2
    e.rename_collection("notes", "papers")
    e.move_collection("papers", str(folder), ["*.txt"])
    assert e.ingest_all() == {"papers": {"indexed": 0, "skipped": 0, "errors": 0, "stale": 2}}
    assert e.remove_collection("papers")[0] == 3 and e.status()["documents"] == 0 and e.sql("SELECT * FROM postings").count() == 0
    with pytest.raises(collections.Unknown):
        e.ingest("papers")
    e.close()


def test_segments_and_merges(spark, tmp_path):
    """Every ingestion writes a segment and a delete set; searches over segments, and after merges, give
    what an index built afresh gives; where nothing has changed nothing is written."""
    d = tmp_path / "in"
    d.mkdir()
    for i in range(6):
        (d / f"{i}.md").write_text(f"common words of file {i} {'rare ' * (i % 3)}")
    e = Engine(spark, str(tmp_path / "w"))
    e.add_collection("c", str(d))
    e.ingest("c")
    first = e.warehouse.segments("postings")

    def hits():
        return sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in index.search(e.live_index, [(1, fulltext.parse_query("common")), (2, fulltext.parse_query("rare OR changed")), (3, fulltext.parse_query("fil*"))]).collect())

    def fresh():
        docs = e.table("documents").where("active").join(e.table("content"), "hash")
        made = index.build(docs, {"path": F.col("path"), "body": F.col("doc")})
        return sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in index.search(made, [(1, fulltext.parse_query("common")), (2, fulltext.parse_query("rare OR changed")), (3, fulltext.parse_query("fil*"))]).collect())

    assert hits() == fresh()
    page = lambda q, **o: [(r["file"], round(r["score"], 9)) for r in e.fts_search(q, 3, **o).collect()]
    (d / "1.md").write_text("changed words, common too")
    (d / "2.md").unlink()
    e.ingest("c")
    second = e.warehouse.segments("postings")
    assert second[:1] == first and len(second) == 2 and e.warehouse.load("postings", [second[1].folder]).select("doc_id").distinct().count() == 1
    assert e.table("index_deletes").count() == 2 and hits() == fresh()
    assert e.live_index.stats.first()["n"] == 5
    for q in ("common", "rare OR changed", "common (rare OR changed)", '"common words"'):
        assert page(q, pruned=True) == page(q)
    files, version = sorted(map(str, (tmp_path / "w").rglob("*"))), e.warehouse.versions()
    assert e.ingest("c")["skipped"] == 5 and e.warehouse.versions() == version and sorted(map(str, (tmp_path / "w").rglob("*"))) == files
    for text in ("again", "and again"):
        (d / "1.md").write_text(f"changed {text} common")
        e.ingest("c")
    assert len(e.warehouse.segments("postings")) == 1  # the fourth filled a tier
    assert e.table("index_deletes").count() == 0 and e.table("index_totals").count() == 1 and hits() == fresh()
    assert e.table("postings").count() == index.build(e.table("documents").where("active").join(e.table("content"), "hash"), {"path": F.col("path"), "body": F.col("doc")}).postings.count()


def test_streaming_exactly_once(spark, tmp_path):
    """A stream that is killed after a commit, before Spark has noted the batch, and started again ends
    with what one batch of the same rows gives, and no batch is committed twice."""
    source, schema = str(tmp_path / "in"), "path string, text string, mtime timestamp"
    put = lambda *rows: spark.createDataFrame([(p, t, datetime.datetime(2024, 1, d)) for p, t, d in rows], schema).coalesce(1).write.mode("append").parquet(source)
    e = Engine(spark, str(tmp_path / "w"))
    e.add_collection("c", source, kind="parquet")
    run = lambda: ingest.ingest_documents(e, "c", source, schema, str(tmp_path / "ck"), files_a_batch=1)
    put(("a.md", "first text", 1), ("b.md", "other text #tag", 1))
    run().awaitTermination()
    versions = e.warehouse.versions()
    put(("a.md", "second text", 2), ("c.md", "third", 2))
    real = e.warehouse.commit

    def killed(*args, **options):
        real(*args, **options)
        raise RuntimeError("killed")

    e.warehouse.commit = killed
    with pytest.raises(Exception, match="killed"):
        run().awaitTermination()
    e.warehouse.commit = real
    assert e.warehouse.batch_of("documents") == 1 and len(e.warehouse.versions()) == len(versions) + 1
    run().awaitTermination()
    assert len(e.warehouse.versions()) == len(versions) + 1
    put(("d.md", "last", 3))
    run().awaitTermination()
    whole = Engine(spark, str(tmp_path / "v"))
    whole.add_collection("c", source, kind="parquet")
    whole.ingest("c")
    state = lambda x: sorted(map(tuple, x.sql("SELECT d.path, d.hash, d.active, l.dl, t.tag FROM documents d LEFT JOIN lengths l ON l.doc_id = d.id LEFT JOIN document_tags t ON t.document_id = d.id").collect()), key=str)
    assert state(e) == state(whole) and e.live_index.stats.first() == whole.live_index.stats.first()
    feed = {r["path"]: r["change"] for r in e.changes(versions[-1]).collect()}
    assert feed == {"a.md": "update", "c.md": "insert", "d.md": "insert"}
    assert {r["path"]: r["change"] for r in e.changes(e.warehouse.versions()[-1], versions[-1]).collect()} == {"a.md": "update", "c.md": "delete", "d.md": "delete"}


def test_unchanged_files_are_not_read(spark, tmp_path, monkeypatch):
    d = tmp_path / "in"
    (d / "_drafts").mkdir(parents=True)
    for name in ("a.md", "_b.md", ".c.md", "_drafts/d.md"):
        (d / name).write_text(f"text of {name}")
    e = Engine(spark, str(tmp_path / "w"))
    e.add_collection("c", str(d))
    asked = []
    source = e.source("c")
    real = source.fetch
    source.fetch = lambda rows: asked.append(rows.count()) or real(rows)
    assert e.ingest("c", source=source)["indexed"] == 4 and e.table("documents").count() == 4
    assert e.ingest("c", source=source) == {"indexed": 0, "skipped": 4, "errors": 0, "stale": 0}
    (d / "a.md").write_text("new text")
    assert e.ingest("c", source=source)["indexed"] == 1 and asked == [4, 0, 1]
    found = e.fetches([f"file://{d}/_b.md", "file:///none"]).collect()
    assert [(r["path"], r["content_type"], r["http_status"]) for r in found] == [("_b.md", "text/markdown", None)] and e.fetches().count() == 4
    assert e.stale_fetches("1 day").count() == 0
    e.clear_fetches([found[0]["id"]])
    assert [r["path"] for r in e.stale_fetches("1 day").collect()] == ["_b.md"] and e.fetches().count() == 3
    assert e.ingest("c", source=source) == {"indexed": 0, "skipped": 4, "errors": 0, "stale": 0} and asked[-1] == 1 and e.fetches([f"file://{d}/_b.md"]).count() == 1


def test_command_line(spark, folder, tmp_path, capsys):
    def run(*args):
        assert cli.main(["--root", str(tmp_path / "w"), *args]) == 0
        return capsys.readouterr().out.strip()

    assert run("collection", "add", "n", str(folder), "--glob", "**/*.md", "--profile", "generic") == "added n"
    assert "n\tfilesystem" in run("collection", "list") and "metadata_profile" in run("collection", "show", "n")
    assert run("index", "n", "--embed") == "indexed 3, skipped 0, errors 1, stale 0; embedded 2, skipped 0, chunks 2"
    assert json.loads(run("search", "soup", "--format", "json"))[0]["file"] == "sub/b.md" and run("vsearch", "soup beans", "--format", "files", "--limit", "1") == "sub/b.md"
    assert "sub/b.md" in run("query", "soup") and "missing_fts: 1 c.md" in run("status", "--check-sync")
    assert run("cleanup").startswith("content 0") and run("backfill-metadata", "--force").startswith("processed 3") and "n: indexed 0" in run("update-all")
    assert "|3" in run("sql", "SELECT count(*) AS n FROM documents") and run("collection", "rename", "n", "m") == "renamed n to m" and run("embed", "m").startswith("embedded 0")
    assert run("collection", "remove", "m") == "removed 3 documents, 3 texts"
    with pytest.raises(SystemExit):
        cli.main(["nothing"])


def test_matcher_and_ontology(spark, tmp_path):
    m = tags.default_matcher(["Python"])
    m.register_alias("PY", "Python")
    assert m.tags == {"python"} and m.resolve("py") == "python" and m.resolve("X") == "x" and m.is_alias("py") and m.aliases["german"] == "de"
    asked = spark.createDataFrame([(1, "py and python tricks")], "query_id long, query string")
    assert [(r["tag"], r["confidence"]) for r in tags.infer(asked, m.frame(spark), m.aliases).collect()] == [("python", 0.9)]
    m.clear()
    assert not m.tags and not m.aliases
    f = tmp_path / "o.json"
    f.write_text(json.dumps({"tags": {"a": {"children": ["b", "c"], "description": "A"}, "b": {"children": ["c"]}}, "parent_weight": 0.5}))
    o = tags.load_ontology(str(f))
    assert o.parents == {"b": "a", "c": "b"} and o.children("a") == ["b"] and o.description("a") == "A" and o.has_tag("c") and not o.has_tag("z") and o.parent_weight == 0.5
    assert tags.Ontology((("a", "b"), ("b", "a"))).closure(3) == [("b", "a", 1), ("b", "b", 2), ("b", "a", 3), ("a", "b", 1), ("a", "a", 2), ("a", "b", 3)]
    (tmp_path / "al.json").write_text(json.dumps({"aliases": {"K8S": "Kubernetes"}}))
    assert tags.load_aliases(str(tmp_path / "al.json")) == {"k8s": "kubernetes"}


def test_cells(spark):
    """Recall of the coarse partition against the exact search."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16)) * 3
    x = (centres[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 16))).astype("float32")
    rows = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], "id long, vec_id long, embedding array<float>")
    held = vectors.put_in_cells(rows, vectors.fit_cells(rows, 16, sample=500))
    asked = [(i, x[i].tolist()) for i in range(0, 2000, 100)]
    exact = {(r["query_id"], r["id"]) for r in vectors.nearest_chunks(rows, asked, 10).collect()}
    near = {(r["query_id"], r["id"]) for r in vectors.nearest_in_cells(held, vectors.fit_cells(rows, 16, sample=500), asked, 10, probes=4).collect()}
    assert len(exact) == 200 and len(near & exact) >= 180


def test_providers(spark):
    class Service(BaseHTTPRequestHandler):
        def _reply(self, body):
            data = json.dumps(body).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self._reply({"data": [{"id": "m"}]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path == "/embeddings":
                self._reply({"data": [{"index": i, "embedding": [float(len(t))]} for i, t in enumerate(body["input"])]})
            else:
                asked = body["messages"][0]["content"]
                self._reply({"choices": [{"message": {"content": "Yes" if "relevant" in asked else "1. other words\n2. q"}}]})

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    p = providers.create("http", base=f"http://127.0.0.1:{server.server_port}", query_prefix="q: ")
    assert p.available() and p.model_exists("m") and not p.model_exists("x")
    assert p.embed(["ab"]) == [[2.0]] and p.embed(["ab"], is_query=True) == [[5.0]] and p.judge("q", "b")
    assert providers.expander(p)("q") == ["q", "other words"]
    server.shutdown()
    dead = providers.create("http", base="http://127.0.0.1:9", timeout=0.2)
    assert not dead.available() and dead.embed(["a"]) == [None] and dead.generate("x") is None
    with pytest.raises(RuntimeError):
        dead.judge("q", "b")
    off = providers.from_environment("NOT_SET_")
    assert off.available() and off.model_exists("hashing") and off.generate("x") is None and providers.expander(off)("q") == ["q"]
    with pytest.raises(ValueError):
        providers.create("none")


def test_tracing():
    told = []
    t = tracing.Tracer(1.0, told.append)
    with pytest.raises(KeyError), t.span("a", k=1), t.span("b"):
        raise KeyError
    assert [s.name for s in told] == ["b", "a"] and told[0].parent == told[1].span_id and told[0].trace_id == told[1].trace_id and told[1].error and told[1].attributes == {"k": 1}
    with tracing.Tracer(0.0).span("x") as s:
        assert s is None


def test_collections_frame(spark):
    e = spark.createDataFrame([], "id long, name string, pwd string, glob_patterns array<string>, source_type string, source_config map<string,string>, created_at timestamp_ntz, updated_at timestamp_ntz")
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    t = collections.create(collections.create(e, "b", "/b", None, now), "a", "/a", ["*.x"], now, config={"k": "v"})
    assert [(r["id"], r["name"]) for r in collections.listed(t).collect()] == [(2, "a"), (1, "b")] and collections.find(t, number=1)["name"] == "b"
    with pytest.raises(collections.Exists):
        collections.rename(t, "a", "b", now)
    moved = collections.need(collections.update_path(t, "a", "/c", now, "*.y"), "a")
    assert moved["pwd"] == "/c" and moved["glob_patterns"] == ["*.y"] and moved["source_config"] == {"k": "v", "glob_patterns": "*.y"}
