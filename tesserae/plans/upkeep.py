"""The ingestion and embedding pipelines and the upkeep of what they store.

Each takes the stored tables as a dict of DataFrames and returns what a commit has to change, table
by table, and a one-row summary. Nothing is written and no row passes the driver; what is computed,
and later written, grows with what has changed, not with the store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, MutableMapping
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import chunking, metadata, models
from tesserae.functions import text as T
from tesserae.operators import blockmax, index, store
from tesserae.schemas import SEGMENTED
from tesserae.warehouse import Append, Change

Stage = Callable[[DataFrame, str], DataFrame]


class Tables(MutableMapping):
    """Tables by name, each made when it is first asked for: what no one reads is not built."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]) -> None:
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __setitem__(self, name: str, table: DataFrame) -> None:
        self._makers[name] = lambda: table
        self._made.pop(name, None)

    def __delitem__(self, name: str) -> None:
        del self._makers[name]
        self._made.pop(name, None)

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def __contains__(self, name: object) -> bool:
        return name in self._makers


@dataclass(frozen=True)
class Run:
    """``rows`` are the changes of keyed tables, ``indexing`` makes those of the index; ``touched`` names
    the documents ``(path, active, hash)`` whose rows change, where the pipeline changes any."""

    rows: dict[str, Change]
    summary: DataFrame
    stored: Mapping[str, DataFrame]
    touched: DataFrame | None = None
    indexing: Callable[[], dict[str, Append]] | None = None

    @cached_property
    def changes(self) -> dict[str, Change | Append]:
        """For a commit."""
        return self.rows | (self.indexing() if self.indexing else {})

    @cached_property
    def tables(self) -> Mapping[str, DataFrame]:
        """The tables that change as they are afterwards; of the index, its live rows."""
        out = {n: lambda n=n, c=c: c.on(self.stored[n]) for n, c in self.rows.items()}
        if self.indexing:
            out |= {"postings": lambda: self.index.live().postings, "lengths": lambda: self.index.live().lengths, "index_totals": lambda: index.totals(self.index.live().lengths)}
        return Tables(out)

    @property
    def index(self) -> index.Index:
        """The index afterwards, with its new segment and delete set."""
        after = {n: self.stored[n] for n in SEGMENTED if n in self.stored}
        for name in SEGMENTED:
            if (given := self.changes.get(name)) and name in after:
                rows = given.rows.withColumn("seg", F.lit(LATEST)) if "seg" in SEGMENTED[name] else given.rows
                after[name] = after[name].unionByName(rows)
        return index_of(after)


#: A version after all others, for what is not committed yet.
LATEST = (1 << 63) - 1


def index_of(tables: dict[str, DataFrame]) -> index.Index:
    return index.Index(tables["postings"], tables["lengths"], tables.get("index_totals"), tables["index_deletes"])


def index_changes(tables: dict[str, DataFrame], gone: DataFrame, new: index.Index | None, stage: Stage) -> dict[str, Append]:
    """A segment, a delete set and a change of the totals."""
    old = index_of(tables)
    made = new or index.Index(old.postings.limit(0).drop("seg"), old.lengths.limit(0).drop("seg"))
    made = replace(made, lengths=stage(made.lengths, "lengths"))
    deletes, delta = index.step(old, gone, made)
    out = {"index_deletes": Append(deletes), "index_totals": Append(delta)}
    return out if new is None else segment(made, stage) | out


def segment(made: index.Index, stage: Stage = lambda df, name: df) -> dict[str, Append]:
    """An index, or what a commit adds to one, as segments of its tables."""
    made = index.staged_runs(made, stage)
    return {"postings": Append(index.laid_out(made)), "lengths": Append(made.lengths), "blocks": Append(blockmax.ordered(blockmax.build(made)))}


def title(text: Column, path: Column) -> Column:
    """A text's first heading, else the file's name without its suffix."""
    return T.title(text, F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""))


def classify(documents: DataFrame, listing: DataFrame, *, force: bool = False, read: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The listing with ``hash``, ``title`` and ``change`` against a collection's documents: ``error``, ``new``,
    ``unchanged_time`` (the stored modification time), ``unchanged_hash`` or ``modified``. Of a path
    that is listed twice the last one modified counts.

    With ``read``, which adds ``text`` and ``error`` to rows of a listing, the listing brings no
    texts and only those of files whose time differs are read. Unchanged rows carry no text.
    """
    old = documents.where("active").select("path", F.col("hash").alias("_old"), F.col("last_modified").alias("_time"))
    told = lambda rows: rows.withColumns({"hash": F.sha2("text", 256), "title": title(F.col("text"), F.col("path"))})
    listing = listing if read is not None else told(listing)  # before rows of a path meet: texts are moved only where they are wanted
    seen = store.last_of(listing, ["path"], ["mtime", "uri"]).join(old, "path", "left")
    same_time = F.coalesce(F.col("_time") == F.col("mtime").cast("string"), F.lit(False)) & F.lit(not force)
    if read is not None:
        same = seen.where(same_time).withColumns({"text": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
        seen = told(read(seen.where(~same_time)).unionByName(same))
    change = F.when(F.col("error").isNotNull(), "error").when(F.col("_old").isNull(), "new")
    if not force:
        change = change.when(same_time, "unchanged_time").when(F.col("_old") == F.col("hash"), "unchanged_hash")
    seen = seen.withColumn("change", change.otherwise("modified")).drop("_old", "_time")
    return seen.withColumn("text", F.when(F.col("change").isin("new", "modified"), F.col("text")))


#: What a source tells of a fetch, beside its time and the file's.
TOLD = ("etag", "http_status", "fetch_duration_ms")
FETCH_COLUMNS = ("source_uri", "last_modified", "last_fetched_at", "content_type", "extra_metadata", *TOLD)


def fetched(rows: DataFrame, now: Column) -> DataFrame:
    """What a fetch leaves on a document row; what the source does not tell is null."""
    extra = F.create_map(F.lit("size"), F.col("size").cast("string"), F.lit("mtime"), F.col("mtime").cast("string"))
    columns = {"source_uri": F.col("uri"), "last_modified": F.col("mtime").cast("string"), "last_fetched_at": now, "content_type": F.col("content_type"), "extra_metadata": extra}
    for c in TOLD:
        columns[c] = (F.col(c) if c in rows.columns else F.lit(None)).cast("string" if c == "etag" else "int")
    return rows.select(*[c for c in rows.columns if c not in columns], *[v.alias(k) for k, v in columns.items()])


def fetches(documents: DataFrame, uris: DataFrame | None = None) -> DataFrame:
    """The fetch metadata of documents that have any: of all, or of those of ``uris(source_uri)``."""
    held = documents.where(F.col("source_uri").isNotNull() | F.col("last_fetched_at").isNotNull()).select("id", *store.KEYS, *FETCH_COLUMNS)
    return held if uris is None else held.join(uris.select("source_uri").distinct(), "source_uri", "left_semi").select(*held.columns)


def stale_fetches(documents: DataFrame, now: Column, age: str) -> DataFrame:
    """Active documents that were never fetched, or not within ``age``, the oldest fetch first."""
    return documents.where("active").where(store.needs_refresh(F.col("last_fetched_at"), now, age)).select("id", *store.KEYS, "source_uri", "last_fetched_at").orderBy(F.col("last_fetched_at").asc_nulls_first(), "id")


def clear_fetches(documents: DataFrame, ids: DataFrame) -> Change:
    """Forgets the fetches of documents ``ids(id)``."""
    types = dict(documents.dtypes)
    rows = documents.join(ids.select("id").distinct(), "id", "left_semi")
    return Change(store.KEYS, rows.select(*[F.lit(None).cast(types[c]).alias(c) if c in FETCH_COLUMNS else F.col(c) for c in documents.columns]))


def index_columns() -> dict[str, Column]:
    return {"path": F.col("path"), "body": F.col("doc")}


def ingest(
    tables: dict[str, DataFrame], listing: DataFrame, collection: int, now: Column, *, force: bool = False, profile: str | None = None, registry: metadata.Registry | None = None, stage: Stage = lambda df, name: df, read: Callable[[DataFrame], DataFrame] | None = None, partial: bool = False
) -> Run:
    """Brings a collection up to a listing ``(uri, path, size, mtime, content_type, text, error)``, or,
    with ``read``, one without texts, of which only touched files are read.

    New and modified files are stored, indexed (a text that is not indexable leaves the index) and
    their metadata extracted; files of unchanged hash have their fetch refreshed; documents that
    the listing no longer holds are deactivated and leave the index, unless it is ``partial``: rows
    that have come, not all there are. ``stage`` may write an intermediate table that several of the
    changes read.
    """
    documents = tables["documents"]
    number = F.lit(collection).cast("long").alias("source_collection_id")
    mine = documents.where(F.col("source_collection_id") == collection)
    seen = stage(classify(mine, listing, force=force, read=read), "listing")
    loaded = seen.where(F.col("change").isin("new", "modified"))
    rows = fetched(loaded, now).select(number, "path", "title", "hash", now.alias("modified_at"), *FETCH_COLUMNS)
    again = fetched(seen.where(F.col("change") == "unchanged_hash"), now).select(number, "path", F.struct(*FETCH_COLUMNS).alias("_f"))
    gone = store.stale(mine, seen).select(*store.KEYS)
    gone = gone.limit(0) if partial else gone
    named = rows.select(*store.KEYS).union(again.select(*store.KEYS)).union(gone)
    part = mine.join(named, store.KEYS, "left_semi")
    changed = store.upsert_documents(part, rows, store.largest_id(documents)).drop("is_new").join(again, store.KEYS, "left")
    refresh = lambda c: F.coalesce(F.col("_f")[c], F.col(c)).alias(c) if c in FETCH_COLUMNS else F.col(c)
    after = stage(store.soft_delete(changed.select(*[refresh(c) for c in documents.columns]), gone), "documents")
    content = stage(store.new_content(tables["content"], loaded.select("hash", F.col("text").alias("doc"), now.alias("created_at"))), "content")
    fresh = loaded.select("path", F.col("text").alias("doc")).join(after.select("id", "path"), "path")
    leaving = fresh.select(F.col("id").alias("doc_id")).union(after.where("not active").select("id")).union(mine.where("not active").select("id"))
    made = index.build(fresh.where(T.is_indexable(F.col("doc"))), index_columns())
    found = fresh.select(F.col("id").alias("document_id"), metadata.document_metadata(F.col("doc"), F.col("path"), F.lit(profile).cast("string"), registry).alias("m"))
    found = stage(found.select("document_id", "m.*", now.alias("extracted_at")), "metadata")
    counts = seen.agg(F.count_if(F.col("change").isin("new", "modified")).alias("indexed"), F.count_if(F.col("change").startswith("unchanged")).alias("skipped"), F.count_if(F.col("change") == "error").alias("errors"))
    return Run(
        {"documents": Change(store.KEYS, after), "content": Change(["hash"], content), **described(found)},
        counts.crossJoin(gone.agg(F.count("*").alias("stale"))),  # single rows
        tables,
        after.select("path", "active", "hash"),
        lambda: index_changes(tables, leaving, made, stage),
    )


def described(found: DataFrame) -> dict[str, Change]:
    """Documents ``(document_id, ..., tags)`` described and tagged anew."""
    tagged = found.select("document_id", F.explode("tags").alias("tag"))
    return {"document_metadata": Change(["document_id"], found, order=["extracted_at"]), "document_tags": Change(["document_id"], tagged, found.select("document_id"))}


def remove_collection(tables: dict[str, DataFrame], number: int, stage: Stage = lambda df, name: df) -> Run:
    """What goes with a collection: its documents with their index rows, tags and metadata, and
    content and vectors that no document, active or not, refers to any more."""
    mine = F.col("source_collection_id") == number
    gone = stage(tables["documents"].where(mine).select("id", *store.KEYS, "hash"), "gone")
    ids, hashes = gone.select(F.col("id").alias("document_id")), gone.select("hash").distinct()
    hashes = stage(hashes.join(tables["documents"].where(~mine).select("hash"), "hash", "left_anti"), "hashes")
    by_hash, by_id = Change(["hash"], gone=hashes), Change(["document_id"], gone=ids)
    changes = {"documents": Change(store.KEYS, gone=gone.select(*store.KEYS)), "content": by_hash, "content_vectors": by_hash, "document_metadata": by_id, "document_tags": by_id}
    left = gone.agg(F.count("*").alias("documents")).crossJoin(hashes.agg(F.count("*").alias("hashes")))  # single rows
    return Run(changes, left, tables, indexing=lambda: index_changes(tables, ids.select(F.col("document_id").alias("doc_id")), None, stage))


def embed_targets(documents: DataFrame, content: DataFrame, vectors: DataFrame, collection: int | None = None, *, force: bool = False) -> DataFrame:
    """``(hash, doc, copies)`` of the distinct texts of active documents that have to be embedded."""
    live = documents.where("active")
    live = live if collection is None else live.where(F.col("source_collection_id") == collection)
    wanted = live.groupBy("hash").agg(F.count("*").alias("copies"))
    wanted = wanted if force else wanted.join(vectors.select("hash"), "hash", "left_anti")
    return wanted.join(content.select("hash", "doc"), "hash")


def embed(
    tables: dict[str, DataFrame], now: Column, model: str, *, embedder=None, collection: int | None = None, force: bool = False, max_bytes: int = chunking.MAX_BYTES, stage: Stage = lambda df, name: df
) -> Run:
    """Embeds the chunks of every distinct text that has no vectors yet (all with ``force``). A
    text that is not indexable gets none and loses those of the model that it has."""
    documents, vectors = tables["documents"], tables["content_vectors"]
    targets = embed_targets(documents, tables["content"], vectors, collection, force=force)
    good = targets.where(T.is_indexable(F.col("doc")))
    lazy = models.embed_chunks(good, "doc", "hash", max_bytes, embedder).select(F.col("id").alias("hash"), "seq", "pos", F.lit(model).alias("model"), now.alias("embedded_at"), "embedding")
    made = stage(lazy, "vectors")
    old = targets.select("hash", F.lit(model).alias("model")) if force else None
    if made is lazy:  # nothing is stored: chunks are counted without being embedded, of texts that moved once
        parts = chunking.chunk(good.select("doc", F.struct("hash", "copies").alias("key")), "doc", "key", max_bytes).where(F.trim("text") != "")
        done = parts.groupBy(F.col("id")["hash"].alias("hash"), F.col("id")["copies"].alias("copies")).agg(F.count("*").alias("n"))
    else:
        done = targets.select("hash", "copies").join(made.groupBy("hash").agg(F.count("*").alias("n")), "hash")
    live = documents.where("active")
    live = live if collection is None else live.where(F.col("source_collection_id") == collection)
    had = live.join(vectors.select("hash"), "hash", "left_semi").agg(F.count("*").alias("had")) if not force else live.sparkSession.range(1).select(F.lit(0).cast("long").alias("had"))
    count = done.agg(F.count("*").alias("embedded"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("again"))
    summary = count.crossJoin(had).select("embedded", (F.col("had") + F.col("again")).alias("skipped"), "chunks")  # single rows
    return Run({"content_vectors": Change(["hash", "model"], made.select(*vectors.columns), old)}, summary, tables)


def cleanup(tables: dict[str, DataFrame], stage: Stage = lambda df, name: df) -> Run:
    """Drops content, vectors, index rows, tags and metadata that no active document refers to. The
    summary has a row a table, with how many of its rows go."""
    live = tables["documents"].where("active")
    old = index_of(tables)
    held = dict(tables) | {"lengths": old.live_lengths, "postings": old.alive(old.postings)}
    by = {"content": "hash", "content_vectors": "hash", "lengths": "doc_id", "postings": "doc_id", "document_metadata": "document_id", "document_tags": "document_id"}
    changes, summary, indexing = {}, None, None
    for name, key in by.items():
        of = live.select(F.col("hash" if key == "hash" else "id").alias(key))
        dead = stage(held[name].join(of, key, "left_anti").groupBy(key).agg(F.count("*").alias("n")), f"dead-{name}")
        line = dead.agg(F.lit(name).alias("table"), F.coalesce(F.sum("n"), F.lit(0)).alias("removed"))
        summary = line if summary is None else summary.union(line)
        if name == "lengths":
            indexing = lambda gone=dead.select("doc_id"): index_changes(tables, gone, None, stage)
        elif name != "postings":
            changes[name] = Change([key], gone=dead.select(key))
    return Run(changes, summary, tables, indexing=indexing)


def backfill(tables: dict[str, DataFrame], now: Column, *, collection: int | None = None, force: bool = False, registry: metadata.Registry | None = None, stage: Stage = lambda df, name: df) -> Run:
    """Extracts metadata of active documents that have none (of all with ``force``); empty texts
    are skipped. A collection's settings may name a profile."""
    live = tables["documents"].where("active")
    live = live if collection is None else live.where(F.col("source_collection_id") == collection)
    forced = tables["source_collections"].select(F.col("id").alias("source_collection_id"), F.element_at("source_config", "metadata_profile").alias("forced"))
    rows = live.select("id", "path", "hash", "source_collection_id").join(forced, "source_collection_id", "left")
    if not force:
        rows = rows.join(tables["document_metadata"].select(F.col("document_id").alias("id")), "id", "left_anti")
    rows = rows.join(tables["content"].select("hash", "doc"), "hash")  # last: texts are moved once
    found = rows.where(F.col("doc") != "").select(F.col("id").alias("document_id"), metadata.document_metadata(F.col("doc"), F.col("path"), F.col("forced"), registry).alias("m"))
    found = stage(found.select("document_id", "m.*", now.alias("extracted_at")), "metadata")
    counts = rows.agg(F.count("*").alias("processed"), F.count_if(F.col("doc") != "").alias("updated"), F.count_if(F.col("doc") == "").alias("skipped"))
    return Run(described(found), counts, tables)


def reindex(tables: dict[str, DataFrame], collection: int, stage: Stage = lambda df, name: df) -> Run:
    """Indexes a collection's active documents anew and takes its other documents out of the index."""
    mine = tables["documents"].where(F.col("source_collection_id") == collection)
    live = mine.where("active").join(tables["content"].select("hash", "doc"), "hash")
    indexing = lambda: index_changes(tables, mine.select(F.col("id").alias("doc_id")), index.build(live, index_columns()), stage)
    return Run({}, mine.where("active").agg(F.count("*").alias("indexed")), tables, indexing=indexing)


def status(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: collections, documents, embedded ones, bytes of content, vectors."""
    live = tables["documents"].where("active")
    have = tables["content_vectors"].select("hash").distinct()
    lines = [
        tables["source_collections"].agg(F.count("*").alias("collections")),
        live.agg(F.count("*").alias("documents"), F.count_distinct("hash").alias("hashes")),
        live.join(have, "hash", "left_semi").agg(F.count("*").alias("embedded")),
        tables["content"].agg(F.coalesce(F.sum(F.octet_length("doc")), F.lit(0)).alias("content_bytes")),
        tables["content_vectors"].agg(F.count("*").alias("vectors")),
        index_of(tables).live_lengths.agg(F.count("*").alias("indexed")),
    ]
    out = lines[0]
    for line in lines[1:]:
        out = out.crossJoin(line)  # single rows
    return out


def issue(rows: DataFrame, name: str, label: str = "path", most: int = 20) -> DataFrame:
    """``(issue, n, samples)``: a count and the first ``most`` labels."""
    first = rows.select(F.col(label).cast("string").alias("_l")).orderBy("_l").limit(most).agg(F.array_sort(F.collect_list("_l")).alias("samples"))  # at most ``most`` rows
    return rows.agg(F.lit(name).alias("issue"), F.count("*").alias("n")).crossJoin(first)


def sync_report(documents: DataFrame, index_ids: DataFrame, vectors: DataFrame, most: int = 20) -> DataFrame:
    """What is missing from, and left over in, the full-text index and the vectors."""
    live = documents.where("active")
    ids, hashes = index_ids.select(F.col("doc_id").alias("id")), vectors.select("hash").distinct()
    left = ids.join(live.select("id"), "id", "left_anti").join(documents.select("id", "path"), "id", "left")
    out = issue(store.orphans(live, ids, ["id"]), "missing_fts", most=most)
    out = out.union(issue(store.orphans(live, hashes, ["hash"]), "missing_embeddings", most=most))
    out = out.union(issue(left.withColumn("path", F.coalesce("path", F.col("id").cast("string"))), "orphan_fts", most=most))
    return out.union(issue(store.orphans(hashes, live, ["hash"]), "orphan_embeddings", "hash", most))
