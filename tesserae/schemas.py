"""The model's tables as Spark schemas."""

from __future__ import annotations

TABLES = {
    "source_collections": "id long, name string, pwd string, glob_patterns array<string>, source_type string, source_config map<string,string>, created_at timestamp_ntz, updated_at timestamp_ntz",
    "content": "hash string, doc string, created_at timestamp_ntz",
    "documents": (
        "id long, source_collection_id long, path string, title string, hash string, active boolean, modified_at timestamp_ntz, source_uri string, etag string, last_modified string, "
        "last_fetched_at timestamp_ntz, fetch_duration_ms int, http_status int, content_type string, extra_metadata map<string,string>"
    ),
    "postings": "doc_id long, col string, token string, key string, positions array<int>, seg long",
    "lengths": "doc_id long, dl int, seg long",
    "blocks": "word string, range long, n long, tf long, dl int, seg long",
    "index_deletes": "doc_id long, seg long",
    "index_totals": "n long, total long",
    "content_vectors": "hash string, seq int, pos long, model string, embedded_at timestamp_ntz, embedding array<float>",
    "document_metadata": "document_id long, profile string, tags array<string>, source_tags array<string>, attributes string, extracted_at timestamp_ntz",
    "document_tags": "document_id long, tag string",
}

#: What tells the rows of a table apart.
ROW_KEYS = {
    "source_collections": ["id"], "content": ["hash"], "documents": ["source_collection_id", "path"], "content_vectors": ["hash", "model", "seq"],
    "document_metadata": ["document_id"], "document_tags": ["document_id", "tag"],
}
#: Tables that lie in buckets by a hash of these columns.
BUCKETED = {"documents": ["source_collection_id", "path"], "content": ["hash"], "content_vectors": ["hash"], "document_metadata": ["document_id"], "document_tags": ["document_id"]}
#: Tables that grow by segments, with their columns.
SEGMENTED = {name: [c.split()[0] for c in TABLES[name].split(", ")] for name in ("postings", "lengths", "blocks", "index_deletes", "index_totals")}
