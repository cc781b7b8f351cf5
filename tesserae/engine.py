"""The engine: collections, ingestion, embedding, upkeep, search and answers over a warehouse."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import config as settings
from tesserae.corpus import StoredCorpus
from tesserae.functions import metadata, models, providers
from tesserae.functions.tracing import span
from tesserae.operators import collections, fulltext, index, store, tags
from tesserae.plans import answers, hybrid, upkeep
from tesserae.schemas import SEGMENTED, TABLES
from tesserae.sources.base import Source, SourceRegistry, shaped
from tesserae.staging import hadoop_path, small, staged
from tesserae.warehouse import Append, Warehouse, full_tier


@dataclass
class Engine:
    """Wires a warehouse, sources, profiles, tags and a model provider. Whatever the provider can't
    do (no reply, no vector) leaves a search without that part."""

    spark: SparkSession
    root: str
    config: settings.Config = field(default_factory=settings.Config)
    provider: providers.Provider = field(default_factory=providers.Offline)
    sources: SourceRegistry = field(default_factory=SourceRegistry)
    registry: metadata.Registry = field(default_factory=metadata.default_registry)
    aliases: dict[str, str] = field(default_factory=tags.load_aliases)
    ontology: tags.Ontology = field(default_factory=tags.load_ontology)

    def __post_init__(self) -> None:
        self.warehouse = Warehouse(self.spark, self.root)

    # -- tables

    def table(self, name: str) -> DataFrame:
        return self.warehouse.read(name)

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in TABLES}

    def sql(self, text: str, args: list | dict | None = None) -> DataFrame:
        """SQL over the warehouse's tables, with positional or named parameters; of the index, its live
        rows."""
        self.warehouse.views()
        live = self.live_index
        live.alive(live.postings).createOrReplaceTempView("postings")
        live.live_lengths.createOrReplaceTempView("lengths")
        return self.spark.sql(text, args=args)

    @property
    def live_index(self) -> index.Index:
        return upkeep.index_of({n: self.table(n) for n in SEGMENTED})

    @staticmethod
    def now():
        return F.lit(datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        return staged(df, name)

    # -- collections

    def add_collection(self, name: str, pwd: str, patterns=None, kind: str = "filesystem", config: dict[str, str] | None = None) -> None:
        self.warehouse.commit({"source_collections": collections.create(self.table("source_collections"), name, pwd, patterns, self.now(), kind, config)})

    def collections(self) -> DataFrame:
        return collections.listed(self.table("source_collections"))

    def collection(self, name: str):
        return collections.need(self.table("source_collections"), name)

    def rename_collection(self, old: str, new: str) -> None:
        self.warehouse.commit({"source_collections": collections.rename(self.table("source_collections"), old, new, self.now())})

    def move_collection(self, name: str, pwd: str, patterns=None) -> None:
        self.warehouse.commit({"source_collections": collections.update_path(self.table("source_collections"), name, pwd, self.now(), patterns)})

    def remove_collection(self, name: str) -> tuple[int, int]:
        """Removes a collection with all that only it needs; counts of documents and hashes gone."""
        row = self.collection(name)
        run = upkeep.remove_collection(self.tables, row["id"], self._stage)
        gone = run.summary.first()
        self.warehouse.commit({"source_collections": self.table("source_collections").where(F.col("id") != row["id"]), **run.changes})
        if self.config.cache_dir:
            store.uncache_documents(self.spark, self.config.cache_dir, name)
        return gone["documents"], gone["hashes"]

    # -- ingestion

    def source(self, name: str) -> Source:
        row = self.collection(name)
        return self.sources.create(row["source_type"], self.spark, row["pwd"], row["source_config"])

    def ingest(self, name: str, *, force: bool = False, source: Source | None = None) -> dict:
        """Brings a collection up to its source in one commit; counts of what was done. A source that
        knows modification times is listed first, and only touched files are read. Where nothing has
        changed nothing is written."""
        row = self.collection(name)
        with span("ingest", collection=name):
            source = source or self.source(name)
            first = source.capabilities.last_modified
            run = upkeep.ingest(
                self.tables, source.listing() if first else source.read(), row["id"], self.now(), force=force, profile=(row["source_config"] or {}).get("metadata_profile"),
                registry=self.registry, stage=self._stage, read=source.fetch if first else None,
            )
            counts = run.summary.first().asDict()
            if not run.touched.isEmpty():
                self.warehouse.commit(run.changes)
                self.merge_index()
            if self.config.cache_dir:
                self._cache(name, row["id"], run.touched)
        return counts

    def ingest_batch(self, name: str, rows: DataFrame, stream: str, number: int) -> int:
        """Ingests a stream's batch of documents exactly once: its number is committed with what it
        changes, and a batch that comes again, after a failure, changes nothing. The version after it."""
        row = self.collection(name)
        if (-1 if (last := self.warehouse.batch_of(stream)) is None else last) >= number:
            return self.warehouse.versions()[-1]
        profile = (row["source_config"] or {}).get("metadata_profile")
        run = upkeep.ingest(self.tables, shaped(rows), row["id"], self.now(), profile=profile, registry=self.registry, stage=self._stage, partial=True)
        version = self.warehouse.commit({} if run.touched.isEmpty() else run.changes, batch=(stream, number))
        self.merge_index()
        return version

    def fetches(self, uris: list[str] | None = None) -> DataFrame:
        """Fetch metadata, of all documents or by address."""
        asked = None if uris is None else small(self.spark, [(u,) for u in uris], "source_uri string")
        return upkeep.fetches(self.table("documents"), asked)

    def stale_fetches(self, age: str) -> DataFrame:
        return upkeep.stale_fetches(self.table("documents"), self.now(), age)

    def clear_fetches(self, ids: list[int]) -> int:
        """Forgets the fetches of some documents, which are then read again; the version after it."""
        change = upkeep.clear_fetches(self.table("documents"), small(self.spark, [(i,) for i in ids], "id long"))
        return self.warehouse.commit({"documents": change})

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """The documents that have changed between two versions; see ``Warehouse.changes``."""
        return self.warehouse.changes("documents", since, until)

    def merge_index(self, fanout: int = index.FANOUT) -> int:
        """Merges index segments while a tier is full; how many merges were made."""
        merges = 0
        while full := full_tier(self.warehouse.segments("postings"), fanout):
            merges += 1
            gone = {s.version for s in full}
            tables = self.tables
            parts = {n: [s.folder for s in self.warehouse.segments(n) if s.version in gone] for n in ("postings", "lengths")}
            made = index.Index(*[self.warehouse.load(n, f) for n, f in parts.items()], deletes=tables["index_deletes"]).live()
            left = [s.version for s in self.warehouse.segments("postings") if s.version not in gone]
            spent = [s.version for s in self.warehouse.segments("index_deletes") if all(v >= s.version for v in left)]
            sums = tables["index_totals"].agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
            every = [s.version for s in self.warehouse.segments("index_totals")]
            made = index.Index(made.postings, self._stage(made.lengths, "lengths"))
            self.warehouse.commit({**upkeep.segment(made), "index_totals": Append(sums)}, drop={"postings": gone, "lengths": gone, "blocks": gone, "index_deletes": spent, "index_totals": every})
        return merges

    def _cache(self, name: str, number: int, touched: DataFrame) -> None:
        """Mirrors as files the texts of a collection's documents whose rows have changed, and removes
        those of inactive ones; all of them where nothing is cached yet."""
        base = self.config.cache_dir
        mine = self.table("documents").where(F.col("source_collection_id") == number)
        path, fs = hadoop_path(self.spark, f"{base.rstrip('/')}/{name}")
        changed = touched if fs.exists(path) else mine.select("path", "active", "hash")
        texts = changed.where("active").join(self.table("content"), "hash").select("path", F.col("doc").alias("text"))
        store.cache_documents(texts, base, name).write.format("noop").mode("overwrite").save()
        store.uncache_paths(changed.where("not active"), base, name).write.format("noop").mode("overwrite").save()

    def ingest_all(self, *, force: bool = False) -> dict[str, dict]:
        """Every collection in turn; one that fails is reported and does not stop the others."""
        out = {}
        for row in self.collections().select("name").collect():
            try:
                out[row["name"]] = self.ingest(row["name"], force=force)
            except Exception as e:
                out[row["name"]] = {"failed": str(e)}
        return out

    def embed(self, name: str | None = None, *, force: bool = False) -> dict:
        number = None if name is None else self.collection(name)["id"]
        with span("embed", collection=name):
            run = upkeep.embed(self.tables, self.now(), self.config.embedding_model, embedder=providers.embedder(self.provider), collection=number, force=force, max_bytes=self.config.chunk_bytes, stage=self._stage)
            counts = run.summary.first().asDict()
            if counts["embedded"] or force:
                self.warehouse.commit(run.changes)
        return counts

    def reindex(self, name: str) -> int:
        """Rebuilds the index rows of a collection's active documents; their count."""
        run = upkeep.reindex(self.tables, self.collection(name)["id"], self._stage)
        self.warehouse.commit(run.changes)
        self.merge_index()
        return run.summary.first()["indexed"]

    def cleanup(self) -> dict[str, int]:
        run = upkeep.cleanup(self.tables, self._stage)
        counts = {r["table"]: r["removed"] for r in run.summary.collect()}  # a row a table
        if any(counts.values()):
            self.warehouse.commit(run.changes)
        return counts

    def backfill(self, name: str | None = None, *, force: bool = False) -> dict:
        number = None if name is None else self.collection(name)["id"]
        run = upkeep.backfill(self.tables, self.now(), collection=number, force=force, registry=self.registry, stage=self._stage)
        self.warehouse.commit(run.changes)
        return run.summary.first().asDict()

    def status(self) -> dict:
        return upkeep.status(self.tables).first().asDict()

    def sync_report(self, most: int = 20) -> DataFrame:
        return upkeep.sync_report(self.table("documents"), self.live_index.live_lengths, self.table("content_vectors"), most)

    # -- search

    @property
    def corpus(self) -> StoredCorpus:
        return StoredCorpus(self.spark, self.tables)

    def _scope(self, name: str | None) -> int | None:
        """A collection's id; an unknown name means all."""
        row = None if name is None else collections.find(self.table("source_collections"), name)
        return None if row is None else row["id"]

    def search_config(self, limit: int | None = None) -> hybrid.SearchConfig:
        c = self.config
        return hybrid.SearchConfig(limit or c.limit, c.min_score, c.fts_weight, c.vec_weight, c.tag_weight, c.rrf_k, candidates=c.candidates, normalize=c.normalize)

    def fts_search(self, text: str, limit: int | None = None, collection: str | None = None, min_score: float = 0.0, *, pruned: bool = False) -> DataFrame:
        """``(query_id, rank, document_id, file, score)``. ``pruned`` skips blocks of postings that can't
        reach the page, at the price of a first pass: for large indexes."""
        scope = hybrid.scope_of(self.spark, [hybrid.Query(1, text, collection=self._scope(collection))])
        found = hybrid.text_list(self.corpus, [(1, fulltext.parse_query(text))], limit or self.config.limit, scope=scope, pruned=pruned)
        return found.where(F.col("score") >= min_score).withColumnRenamed("filepath", "file").orderBy("rank")

    def vector_search(self, text: str, limit: int | None = None, collection: str | None = None, min_score: float = 0.0) -> DataFrame:
        vector = self.provider.embed([text], is_query=True)[0]
        scope = hybrid.scope_of(self.spark, [hybrid.Query(1, text, collection=self._scope(collection))])
        asked = [(1, vector)] if vector else []
        found = hybrid.vector_list(self.corpus, asked, limit or self.config.limit, scope=scope, min_score=min_score)
        return found.withColumnRenamed("filepath", "file").orderBy("rank")

    def query(self, text: str, limit: int | None = None, collection: str | None = None, *, expand: bool = False, rerank: bool = False) -> DataFrame:
        """Hybrid search, by wish with a model's query variations and judgements."""
        vector = self.provider.embed([text], is_query=True)[0] or ()
        variants = tuple(providers.expander(self.provider)(text)[1:]) if expand else ()
        asked = [hybrid.Query(1, text, tuple(vector), variants, self._scope(collection))]
        judge = (lambda ranked: self.judge(ranked, text)) if rerank else None
        return hybrid.hybrid(self.corpus, asked, self.search_config(limit), judge, self.aliases, self.ontology)

    def judge(self, ranked: DataFrame, text: str) -> DataFrame:
        bodies = self.corpus.texts(ranked.select("query_id", "filepath", "document_id").join(self.corpus.documents.select(F.col("id").alias("document_id"), "hash"), "document_id"))
        provider = self.provider
        return models.judge(bodies.select("query_id", "filepath", F.lit(text).alias("query"), F.substring("text", 1, 1000).alias("body")), provider.judge)

    def passages(self, text: str | list[str], k: int = 5) -> list[dict]:
        """The best documents as ``text, score, file, title``; several queries are asked as one."""
        asked = " ".join(text) if isinstance(text, list) else text
        found = self.query(asked, k).select("query_id", "pos", "file", "score", "document_id")
        docs = self.corpus.texts(self.corpus.documents).select("path", "title", "text")
        rows = answers.passages(found, docs, k).orderBy("pos").collect()  # ``k`` rows
        return [{"text": r["text"], "score": r["score"], "file": r["file"], "title": r["title"]} for r in rows]

    def answer(self, question: str, k: int = 5) -> dict:
        rows = self.passages(question, k)
        context = "\n\n".join(f"[{i + 1}] {r['title']}:\n{r['text']}" for i, r in enumerate(rows))
        return answers.answer(question, context, self.provider.generate)

    def close(self) -> None:
        self.provider.close()
