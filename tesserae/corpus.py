"""The document-search model as views over the stored tables.

``documents`` rows become content-addressed documents: a path, a collection, a hash of the text
and an active flag. Chunk vectors, tags and the two indexes derive from them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import blockmax, index
from tesserae.staging import hadoop_path, staged

_INDEXES: dict[tuple, index.Index] = {}
_BLOCKS: dict[int, DataFrame] = {}


@dataclass
class Corpus:
    """Lazy DataFrames of the model; nothing is read before a query runs."""

    spark: SparkSession
    root: str
    _read: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def table(self, name: str) -> DataFrame:
        if name not in self._read:  # the schema is read once
            self._read[name] = self.spark.read.parquet(f"{self.root.rstrip('/')}/{name}.parquet")
        return self._read[name]

    @cached_property
    def documents(self) -> DataFrame:
        d = self.table("documents")
        return d.select(
            F.col("doc_id").alias("id"),
            F.substring("source", 4, 20).cast("long").alias("source_collection_id"),
            F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
            F.sha2("text", 256).alias("hash"),
            (F.col("doc_id") % 11 != 0).alias("active"),
            "text",
            "lang",
            "source",
        )

    @property
    def active(self) -> DataFrame:
        return self.documents.where("active")

    @property
    def content(self) -> DataFrame:
        """One row a hash; copies collapse with map-side combining."""
        return self.documents.groupBy("hash").agg(F.min("text").alias("doc"))

    @property
    def fts_ids(self) -> DataFrame:
        """Ids in the full-text index: stale for every seventh document."""
        return self.documents.where(F.col("id") % 7 != 0).select("id")

    @property
    def index(self) -> index.Index:
        """The full-text index of these documents: built once a session and table, stored in the
        shared folder, and only read by searches."""
        path, fs = hadoop_path(self.spark, f"{self.root.rstrip('/')}/documents.parquet")
        key = (self.spark.sparkContext.applicationId, self.root, fs.getFileStatus(path).getModificationTime())
        if key not in _INDEXES:
            made = self.make_index()
            lengths = staged(made.lengths, "lengths")
            _INDEXES[key] = index.Index(staged(index.laid_out(index.staged_runs(made, staged)), "postings"), lengths, staged(index.totals(lengths), "totals"))
        return _INDEXES[key]

    @property
    def token_blocks(self) -> DataFrame:
        """The bounds of that index's blocks by token, stored beside it."""
        at = self.index
        if id(at) not in _BLOCKS:
            _BLOCKS[id(at)] = staged(blockmax.ordered(blockmax.build(at, stemmed=False)), "blocks")
        return _BLOCKS[id(at)]

    def make_index(self) -> index.Index:
        docs = self.documents.join(self.fts_ids, "id", "left_semi")
        return index.build(docs, {"path": F.col("path"), "body": F.col("text")})

    @cached_property
    def vectors(self) -> DataFrame:
        """Chunk vectors by content hash and sequence number."""
        count = self.documents.agg(F.count("*").alias("n"))
        e = self.table("embeddings").crossJoin(F.broadcast(count))  # one row: the table's count
        e = e.select("vec_id", "embedding", (F.col("vec_id") % F.col("n")).alias("id"), F.floor(F.col("vec_id") / F.col("n")).cast("int").alias("seq"))
        return e.where(F.col("id") % 5 != 0).join(self.documents.select("id", "hash", "path", "active", "source_collection_id"), "id")

    @cached_property
    def tags(self) -> DataFrame:
        """``(document_id, tag)``: the inverted tag index."""
        tag = F.array(F.col("lang"), F.concat(F.lit("proj/"), F.col("source")), F.concat(F.lit("topic-"), (F.col("id") % 7).cast("string")))
        return self.documents.select(F.col("id").alias("document_id"), F.explode(tag).alias("tag"))

    @property
    def decorated(self) -> DataFrame:
        """Texts with frontmatter, a heading and an inline tag, for the text functions."""
        text = F.concat(
            F.lit("---\ntags: ["), "lang", F.lit(", proj/"), "source", F.lit("]\n---\n# Doc "), F.col("id").cast("string"), F.lit("\n\n#"), "lang", F.lit("/"), "source", F.lit(" "), "text"
        )
        return self.documents.select("id", "path", "lang", "source", text.alias("text"))


@dataclass
class StoredCorpus:
    """The same views over a warehouse's tables."""

    spark: SparkSession
    tables: dict[str, DataFrame]

    @property
    def documents(self) -> DataFrame:
        return self.tables["documents"].select("id", "source_collection_id", "path", "title", "hash", "active")

    @property
    def active(self) -> DataFrame:
        return self.documents.where("active")

    @property
    def index(self) -> index.Index:
        return index.Index(self.tables["postings"], self.tables["lengths"], self.tables["index_totals"], self.tables["index_deletes"])

    @property
    def blocks(self) -> DataFrame:
        return self.tables["blocks"]

    @property
    def vectors(self) -> DataFrame:
        return self.tables["content_vectors"].select("hash", "seq", F.col("seq").cast("long").alias("vec_id"), "embedding").join(self.documents, "hash")

    @property
    def tags(self) -> DataFrame:
        return self.tables["document_tags"]

    def texts(self, hashes: DataFrame) -> DataFrame:
        return hashes.join(self.tables["content"].select("hash", F.col("doc").alias("text")), "hash")


#: The same views in SQL, for the twins.
VIEWS = """
WITH docs AS (
  SELECT doc_id AS id, CAST(substr(source, 4) AS BIGINT) AS source_collection_id, lang || '/' || doc_id || '.md' AS path,
         sha256(text) AS hash, doc_id % 11 <> 0 AS active, text, lang, source
  FROM documents
), content AS (SELECT hash, min(text) AS doc FROM docs GROUP BY hash
), fts AS (SELECT id FROM docs WHERE id % 7 <> 0
), vectors AS (
  SELECT e.vec_id, e.embedding, e.id, e.seq, d.hash, d.path, d.active, d.source_collection_id
  FROM (SELECT vec_id, embedding, vec_id % (SELECT count(*) FROM documents) AS id, CAST(vec_id // (SELECT count(*) FROM documents) AS INTEGER) AS seq FROM embeddings) e
  JOIN docs d USING (id) WHERE e.id % 5 <> 0
), tags AS (
  SELECT id AS document_id, unnest([lang, 'proj/' || source, 'topic-' || (id % 7)]) AS tag FROM docs
), decorated AS (
  SELECT id, path, lang, source, '---' || chr(10) || 'tags: [' || lang || ', proj/' || source || ']' || chr(10) || '---' || chr(10) || '# Doc ' || id || chr(10) || chr(10) || '#' || lang || '/' || source || ' ' || text AS text
  FROM docs
)
"""
