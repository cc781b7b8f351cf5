"""The registry: queries by name, and SQL twins that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.corpus import VIEWS, Corpus
from tesserae.functions import chunking, metadata, stemming
from tesserae.functions import text as T
from tesserae.operators import blockmax, collections, fulltext, fusion, index, store, tags, vectors
from tesserae.plans import hybrid as H
from tesserae.plans import upkeep
from tesserae.schemas import TABLES
from tesserae.sources import files
from tesserae.staging import small, temporary
from tesserae.warehouse import Warehouse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The batch of searches that the registered queries ask.
SEARCHES = [(1, ["from", "with"]), (2, ["nicht", "das"]), (3, ["este", "por"]), (4, ["pour"])]
VECTOR_IDS = (3, 42, 77)
NOW = "2024-06-01 00:00:00"


def query(name: str, sql: str | None = None, views: bool = True):
    def add(make: Callable[[Corpus], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: make(Corpus(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = (VIEWS if views else "") + sql
        return make

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# -- lookups and filters


@query("active_docs", "SELECT id, source_collection_id, path, hash FROM docs WHERE active")
def _(c):
    return c.active.select("id", "source_collection_id", "path", "hash")


@query("docs_with_content", "SELECT d.id, d.path, length(c.doc) AS n FROM docs d JOIN content c USING (hash) WHERE d.active")
def _(c):
    return c.active.join(c.content, "hash").select("id", "path", F.length("doc").cast("long").alias("n"))


@query("path_prefix", "SELECT id, path FROM docs WHERE active AND path ILIKE 'FR/1%'")
def _(c):
    return c.active.where(F.col("path").ilike("FR/1%")).select("id", "path")


@query("point_lookup", "SELECT id, path, hash FROM docs WHERE active AND source_collection_id = 3 AND path IN ('en/23.md', 'fr/23.md', 'de/23.md', 'es/23.md')")
def _(c):
    keys = F.col("path").isin(*[f"{x}/23.md" for x in ("en", "fr", "de", "es")])
    return c.active.where((F.col("source_collection_id") == 3) & keys).select("id", "path", "hash")


@query("ids_by_paths", "SELECT path, max(id) AS id FROM docs WHERE active AND path IN ('en/1.md', 'en/2.md', 'fr/3.md', 'es/5.md') GROUP BY path")
def _(c):
    return c.active.where(F.col("path").isin("en/1.md", "en/2.md", "fr/3.md", "es/5.md")).groupBy("path").agg(F.max("id").alias("id"))


@query("content_dedup", "SELECT hash, count(*) AS copies, min(id) AS first_id FROM docs GROUP BY hash")
def _(c):
    return c.documents.groupBy("hash").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))


@query("content_exists", "SELECT id FROM docs WHERE hash IN (SELECT hash FROM vectors)")
def _(c):
    return c.documents.join(c.vectors.select("hash"), "hash", "left_semi").select("id")


@query("check_modified", "SELECT d.id, (d.id % 13 = 0 OR d.id % 17 = 0) AS modified FROM docs d")
def _(c):
    stored = c.documents.where(F.col("id") % 13 != 0).select("path", "hash")
    now = c.documents.select("id", "path", F.sha2(F.when(F.col("id") % 17 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return now.join(store.changes(stored, now), "path").select("id", (F.col("change") != "unchanged").alias("modified"))


@query("stale_documents", f"SELECT id FROM docs WHERE active AND (id % 19 = 0 OR TIMESTAMP '2024-05-31 00:00:00' + INTERVAL 1 MINUTE * (id % 3000) < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR)")
def _(c):
    fetched = F.when(F.col("id") % 19 != 0, F.timestamp_seconds(F.unix_timestamp(F.lit("2024-05-31 00:00:00").cast("timestamp")) + (F.col("id") % 3000) * 60))
    cut = F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 1 HOUR")
    return c.active.where(fetched.isNull() | (fetched < cut)).select("id")


@query("is_indexable", "SELECT id, (trim(t, ' ' || chr(10)) <> '' AND NOT (starts_with(trim(t, ' ' || chr(10)), '# ') AND NOT contains(trim(t, ' ' || chr(10)), chr(10)))) AS indexable FROM (SELECT id, CASE WHEN id % 5 = 0 THEN '# Doc ' || id || chr(10) || ' ' WHEN id % 5 = 1 THEN ' ' || chr(10) ELSE text END AS t FROM docs)")
def _(c):
    t = F.when(F.col("id") % 5 == 0, F.concat(F.lit("# Doc "), F.col("id").cast("string"), F.lit("\n "))).when(F.col("id") % 5 == 1, F.lit(" \n")).otherwise(F.col("text"))
    return c.documents.select("id", T.is_indexable(t).alias("indexable"))


# -- text functions


@query("extract_title", "SELECT id, CASE WHEN contains(text, chr(10) || '# ') THEN trim(split_part(split_part(text, chr(10) || '# ', 2), chr(10), 1)) ELSE path END AS title FROM decorated")
def _(c):
    return c.decorated.select("id", T.title(F.col("text"), F.col("path")).alias("title"))


@query("frontmatter_split", r"SELECT id, regexp_extract(text, '(?s)\A---[ \t\r]*\n(.*?)\n?---[ \t\r]*\n?', 1) AS front, sha256(regexp_replace(text, '(?s)\A---[ \t\r]*\n(.*?)\n?---[ \t\r]*\n?', '')) AS body_hash FROM decorated")
def _(c):
    return c.decorated.select("id", T.frontmatter(F.col("text")).alias("front"), F.sha2(T.body(F.col("text")), 256).alias("body_hash"))


@query("inline_tags", r"""SELECT id, len(t) AS n, coalesce(t[1], '') AS first_tag FROM (SELECT id, regexp_extract_all(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '`[^`]+`', ' ', 'g'), '(?:^|[\s(\["{])#([a-zA-Z][a-zA-Z0-9_/-]*)', 1) AS t FROM decorated)""")
def _(c):
    found = c.decorated.select("id", T.inline_tags(F.col("text")).alias("t"))
    return found.select("id", F.size("t").cast("long").alias("n"), F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first_tag"))


@query("normalize_tags", "SELECT document_id, tag, trim(lower(ltrim('##' || upper(tag), '#'))) AS norm FROM tags")
def _(c):
    return c.tags.select("document_id", "tag", T.normalize_tag(F.concat(F.lit("##"), F.upper("tag"))).alias("norm"))


@query("expand_nested_tags", "SELECT document_id, array_to_string(p[1:i], '/') AS tag FROM (SELECT document_id, string_split(tag, '/') AS p, unnest(range(1, len(string_split(tag, '/')) + 1)) AS i FROM tags)")
def _(c):
    return c.tags.select("document_id", F.explode(T.nested_tags(F.col("tag"))).alias("tag"))


@query("detect_profile", r"SELECT id, CASE WHEN contains(p, 'vault') THEN 'obsidian' WHEN contains(p, 'drafts') THEN 'drafts' WHEN regexp_matches(text, '\[\[[^\]]+\]\]') OR contains(text, '%%') OR regexp_matches(text, '#[a-zA-Z]+/[a-zA-Z]+') THEN 'obsidian' WHEN regexp_matches(text, 'uuid:\s*[a-f0-9-]{36}') OR contains(text, 'created_latitude:') THEN 'drafts' ELSE 'generic' END AS profile FROM (SELECT id, text, CASE id % 4 WHEN 0 THEN 'vault/' || path WHEN 1 THEN 'drafts/' || path ELSE path END AS p FROM docs)")
def _(c):
    p = F.when(F.col("id") % 4 == 0, F.concat(F.lit("vault/"), "path")).when(F.col("id") % 4 == 1, F.concat(F.lit("drafts/"), "path")).otherwise(F.col("path"))
    return c.documents.select("id", T.profile(p, F.col("text")).alias("profile"))


@query("nested_tag_edges", "SELECT document_id, tag, '' AS part FROM tags UNION ALL SELECT document_id, tag, array_to_string(p[1:i], '/') FROM (SELECT document_id, tag, string_split(tag, '/') AS p, unnest(range(1, len(string_split(tag, '/')) + 1)) AS i FROM tags)")
def _(c):
    return c.tags.select("document_id", "tag", F.explode(T.nested_tags(F.concat(F.lit("/"), "tag"))).alias("part"))


_SUFFIXES = [".MD", ".markdown", ".txt", ".rst", ".html", ".htm", ".json", ".yaml", ".yml", ".xml", ".csv", ".bin", ""]
_MIMES = ["text/markdown", "text/markdown", "text/plain", "text/x-rst", "text/html", "text/html", "application/json", "text/yaml", "text/yaml", "application/xml", "text/csv", "text/plain", "text/plain"]


@query("mime_types", f"SELECT doc_id || ({_SUFFIXES!r})[doc_id % 13 + 1] AS path, ({_MIMES!r})[doc_id % 13 + 1] AS mime FROM documents", views=False)
def _(c):
    end = F.get(F.array(*map(F.lit, _SUFFIXES)), (F.col("id") % 13).cast("int"))
    return c.documents.select(F.concat(F.col("id").cast("string"), end).alias("path")).select("path", T.mime_type(F.col("path")).alias("mime"))


@query("glob_matches", r"SELECT id, regexp_matches(p, '(^|/)[^/]*\.md$') AND NOT regexp_matches(p, '(^|/)drafts(/|$)') AND NOT regexp_matches(p, '(^|/)fr/[^/]*$') AS taken FROM (SELECT id, CASE id % 3 WHEN 0 THEN 'drafts/' || path WHEN 1 THEN 'a/' || path ELSE replace(path, '.md', '.txt') END AS p FROM docs)")
def _(c):
    p = F.when(F.col("id") % 3 == 0, F.concat(F.lit("drafts/"), "path")).when(F.col("id") % 3 == 1, F.concat(F.lit("a/"), "path")).otherwise(F.regexp_replace("path", r"\.md", ".txt"))
    return c.documents.select("id", files.matches_patterns(p, ["*.md", "!**/drafts/**", "!fr/*"]).alias("taken"))


@query("html_pages", r"SELECT url AS path, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<head\b.*?</head\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages", views=False)
def _(c):
    return files.read_pages(c.table("pages"))


@query("masked_settings", "SELECT id, 'api_token' AS k, '***' AS v FROM docs UNION ALL SELECT id, 'Password', '***' FROM docs UNION ALL SELECT id, 'path', path FROM docs")
def _(c):
    held = F.create_map(F.lit("api_token"), "hash", F.lit("Password"), "lang", F.lit("path"), "path")
    return c.documents.select("id", F.explode(T.mask_secrets(held)).alias("k", "v"))


@query("chunk_stats", "SELECT id, strlen(text) AS n_bytes, length(text) AS n_chars, length(text) // 4 AS tokens FROM docs")
def _(c):
    return c.documents.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.length("text").cast("long").alias("n_chars"), T.token_estimate(F.col("text")).alias("tokens"))


#: The greedy fold over lines as a recursive query.
CHUNKS = """, long_ AS (SELECT key, string_split(text, chr(10)) AS ls FROM to_chunk WHERE strlen(text) > 6144 AND trim(text, ' ' || chr(10)) <> ''
), flat AS (SELECT key, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM long_
), walked AS (SELECT * FROM (WITH RECURSIVE walk(key, i, seq, pos, size) AS (SELECT key, i, 0, 0::BIGINT, strlen(line) + 1 FROM flat WHERE i = 1
  UNION ALL SELECT w.key, f.i, CASE WHEN w.size + strlen(f.line) + 1 > 6144 THEN w.seq + 1 ELSE w.seq END, CASE WHEN w.size + strlen(f.line) + 1 > 6144 THEN w.pos + w.size ELSE w.pos END, CASE WHEN w.size + strlen(f.line) + 1 > 6144 THEN 0 ELSE w.size END + strlen(f.line) + 1
  FROM walk w JOIN flat f ON f.key = w.key AND f.i = w.i + 1) SELECT * FROM walk)
), parts AS (SELECT key, seq, pos, regexp_replace(string_agg(line, chr(10) ORDER BY i), '\\s+$', '') AS part, seq = max(seq) OVER (PARTITION BY key) AS last FROM walked JOIN flat USING (key, i) GROUP BY key, seq, pos
), chunks AS (SELECT key, seq, pos, part FROM parts WHERE NOT last OR part <> '' UNION ALL SELECT key, 0, 0, text FROM to_chunk WHERE strlen(text) <= 6144 AND trim(text, ' ' || chr(10)) <> '')
"""


@query("chunk_documents", ", to_chunk AS (SELECT id AS key, text FROM docs)" + CHUNKS + "SELECT key AS id, seq, pos, sha256(part) AS chunk_hash, strlen(part) AS n_bytes FROM chunks")
def _(c):
    found = chunking.chunk(c.documents)
    return found.select("id", F.col("seq").cast("long").alias("seq"), "pos", F.sha2("text", 256).alias("chunk_hash"), F.octet_length("text").cast("long").alias("n_bytes"))


@query(
    "document_metadata",
    """, m AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'generic' WHEN id % 3 = 1 THEN 'drafts' ELSE 'obsidian' END AS profile, lang, source FROM docs)
SELECT id, profile, array_to_string(list_sort(list_distinct([lang, 'proj/' || source, lang || '/' || source] || CASE profile WHEN 'obsidian' THEN ['proj'] ELSE [] END)), ',') AS tags, lang || ',proj/' || source || ',#' || lang || '/' || source AS source_tags,
  CASE profile WHEN 'drafts' THEN '{"flagged": "True"}' ELSE '{"title": "T' || id || '"}' END AS attributes FROM m""",
)
def _(c):
    text = F.concat(F.lit("---\ntitle: T"), F.col("id").cast("string"), F.lit("\nflagged: true\n"), F.substring("text", 5, 1 << 30))
    forced = F.when(F.col("id") % 3 == 0, "generic").when(F.col("id") % 3 == 1, "drafts")
    d = c.decorated.select("id", metadata.document_metadata(text, F.col("path"), forced).alias("m"))
    return d.select("id", "m.profile", F.array_join("m.tags", ",").alias("tags"), F.array_join("m.source_tags", ",").alias("source_tags"), "m.attributes")


@query("parse_variations", "SELECT conv_id, turn, 'first ' || turn AS v1, 'second ' || role AS v2, 'twelfth. on' AS v3, 'x' AS v4 FROM conversations", views=False)
def _(c):
    reply = F.concat(F.lit("1. first "), F.col("turn").cast("string"), F.lit(".\n\n- second "), F.col("role"), F.lit("?\n12. twelfth. on\n• x!\nfifth"))
    held = c.table("conversations").withColumn("v", T.variations(reply, 4))
    return held.select("conv_id", "turn", *[F.get("v", F.lit(i)).alias(f"v{i + 1}") for i in range(4)])


@query("json_props", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2", views=False)
def _(c):
    k = F.from_json("props", "k long")["k"]
    return c.table("events").select("event_type", k.alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("prefix_slice", "SELECT id, left(text, 200) AS snippet FROM docs")
def _(c):
    return c.documents.select("id", F.substring("text", 1, 200).alias("snippet"))


# -- full text

_INDEX = """, raw AS (SELECT d.id, 'path' AS col, regexp_extract_all(lower(d.path), '[\\p{L}\\p{N}]+') AS w FROM docs d JOIN fts USING (id) UNION ALL SELECT d.id, 'body', regexp_extract_all(lower(d.text), '[\\p{L}\\p{N}]+') FROM docs d JOIN fts USING (id)
), pos AS (SELECT id, col, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM raw
), lens AS (SELECT id, CAST(sum(len(w)) AS BIGINT) AS dl FROM raw GROUP BY id
), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens)
"""


def _page(name: str, units: str, met: str, limit: int = 15) -> str:
    """The best rows of each query from the counts ``(query_id, leaf, id, tf)`` of its units."""
    return f""", {name}_u AS ({units}
), {name}_i AS (SELECT query_id, leaf, avgdl, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) AS idf FROM (SELECT query_id, leaf, count(*) AS df FROM {name}_u GROUP BY ALL), st
), {name}_s AS (SELECT u.query_id, u.id, sum(i.idf * u.tf * 2.2 / (u.tf + 1.2 * (0.25 + 0.75 * l.dl / i.avgdl))) AS score, list(u.leaf) AS have FROM {name}_u u JOIN {name}_i i USING (query_id, leaf) JOIN lens l USING (id) GROUP BY u.query_id, u.id
), {name} AS (SELECT * FROM (SELECT s.query_id, s.id, s.score, row_number() OVER (PARTITION BY s.query_id ORDER BY round(s.score, 9) DESC, s.id) - 1 AS rank FROM {name}_s s JOIN docs d ON d.id = s.id AND d.active WHERE {met}) WHERE rank < {limit})
"""


def _all_of(searches: list[tuple[int, list[str]]], table: str = "pos", field: str = "term") -> tuple[str, str]:
    """Units and condition of queries that ask for all of their words."""
    rows = ", ".join(f"({q}::BIGINT, {i}, '{t}')" for q, ts in searches for i, t in enumerate(ts))
    units = f"SELECT a.query_id, a.leaf, p.id, count(*) AS tf FROM {table} p JOIN (VALUES {rows}) a(query_id, leaf, word) ON a.word = p.{field} GROUP BY ALL"
    return units, "len(have) = CASE s.query_id " + " ".join(f"WHEN {q} THEN {len(ts)}" for q, ts in searches) + " END"


_BM25 = _INDEX + _page("page", *_all_of(SEARCHES))


def _parsed(queries: list[tuple[int, str]]):
    return [(q, fulltext.parse_query(t)) for q, t in queries]


def _bm25(c, queries=None, stemmed: bool = False):
    asked = _parsed(queries or [(q, " ".join(ts)) for q, ts in SEARCHES])
    hits = index.search(c.index, asked, stemmed=stemmed).join(c.active.select("id", "path"), "id")
    return fulltext.top_hits(hits, 15)


def _long(name: str):
    return F.col(name).cast("long").alias(name)


@query("bm25_search", _BM25 + "SELECT query_id, id, rank, round(score / min(score) OVER (PARTITION BY query_id), 6) AS score FROM page")
def _(c):
    return fulltext.normalize_hits(_bm25(c)).select("query_id", "id", _long("rank"), r6(F.col("score"), "score"))


@query("bm25_max_normalized", _BM25 + "SELECT query_id, id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM page")
def _(c):
    return fulltext.normalize_hits(_bm25(c), "max").select("query_id", "id", r6(F.col("score"), "score"))


_WORD = "SELECT {q}::BIGINT AS query_id, {n} AS leaf, id, count(*) AS tf FROM pos WHERE {where} GROUP BY id"
#: Words under OR and AND, for the search that skips blocks.
SKIPPED = [(1, "from OR with OR the"), (2, "nicht das"), (3, "este OR por"), (4, "pour"), (5, "of (from OR nicht)")]
_SKIPPED = " UNION ALL ".join(_WORD.format(q=q, n=n, where=f"term = '{t}'") for q, ts in ((1, ("from", "with", "the")), (2, ("nicht", "das")), (3, ("este", "por")), (4, ("pour",)), (5, ("of", "from", "nicht"))) for n, t in enumerate(ts))


@query("bm25_block_max", _INDEX + _page("page", _SKIPPED, "CASE s.query_id WHEN 2 THEN len(have) = 2 WHEN 5 THEN list_contains(have, 0) AND len(have) > 1 ELSE true END") + "SELECT query_id, id, rank, round(score, 6) AS score FROM page")
def _(c):
    """Blocks of postings whose bound can't reach the page are skipped; the hits are those of the whole search."""
    found = blockmax.search(c.index, c.token_blocks, _parsed(SKIPPED), 15, c.active.select("id"), stemmed=False)
    return fulltext.top_hits(found.hits, 15).select("query_id", "id", _long("rank"), r6(F.col("score"), "score"))


STEMS = [(1, ["from", "with"]), (2, ["nichts", "das"]), (3, ["estes", "pores"]), (4, ["tion"]), (5, ["être"])]
_KEYED = """, keys AS (SELECT term, stem FROM (SELECT DISTINCT term, strip_accents(term) AS folded FROM pos) JOIN (SELECT DISTINCT token, stem FROM (__STEM__)) ON token = folded
), keyed AS (SELECT p.id, p.col, k.stem, p.p FROM pos p JOIN keys k USING (term))
""".replace("__STEM__", stemming.stem_sql("SELECT DISTINCT strip_accents(term) AS t FROM pos", "t"))


@query("bm25_search_porter", _INDEX + _KEYED + _page("page", *_all_of([(q, [stemming.stem(T.fold_text(t)) for t in ts]) for q, ts in STEMS], "keyed", "stem")) + "SELECT query_id, id, rank, round(score, 6) AS score FROM page")
def _(c):
    """Words without diacritics, stemmed; the twin has the stemmer's rules as SQL."""
    return _bm25(c, [(q, " ".join(ts)) for q, ts in STEMS], stemmed=True).select("query_id", "id", _long("rank"), r6(F.col("score"), "score"))


#: The grammar, ranked: OR, NOT, prefix, phrase, a column, NEAR.
GRAMMAR = [(1, "from OR nicht"), (2, "from NOT with"), (3, "fro*"), (4, '"of the"'), (5, "path:fr pour"), (6, "NEAR(from with, 5)"), (7, 'AND_ OR "of the" NOT body:fr*')]
_PAIR = "SELECT {q}::BIGINT, {n}, a.id, count(*) FROM pos a JOIN pos b ON a.id = b.id AND a.col = b.col AND b.p = a.p + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.id"
_CLOSE = "SELECT {q}::BIGINT, {n}, p.id, count(*) FROM pos p WHERE p.term = '{t}' AND (p.id, p.col) IN (SELECT (a.id, a.col) FROM pos a JOIN pos b ON a.id = b.id AND a.col = b.col WHERE a.term = 'from' AND b.term = 'with' AND abs(a.p - b.p) <= 6) GROUP BY p.id"
_UNITS = " UNION ALL ".join(
    [
        _WORD.format(q=1, n=0, where="term = 'from'"), _WORD.format(q=1, n=1, where="term = 'nicht'"), _WORD.format(q=2, n=0, where="term = 'from'"), _WORD.format(q=2, n=1, where="term = 'with'"),
        _WORD.format(q=3, n=0, where="starts_with(term, 'fro')"), _PAIR.format(q=4, n=0), _WORD.format(q=5, n=0, where="term = 'fr' AND col = 'path'"), _WORD.format(q=5, n=1, where="term = 'pour'"),
        _CLOSE.format(q=6, n=0, t="from"), _CLOSE.format(q=6, n=1, t="with"), _WORD.format(q=7, n=0, where="term = 'and'"), _PAIR.format(q=7, n=1), _WORD.format(q=7, n=2, where="starts_with(term, 'fr') AND col = 'body'"),
    ]
)
_MET = "CASE s.query_id WHEN 2 THEN NOT list_contains(have, 1) WHEN 5 THEN len(have) = 2 WHEN 7 THEN list_contains(have, 0) OR (list_contains(have, 1) AND NOT list_contains(have, 2)) ELSE true END"


@query("bm25_grammar", _INDEX + _page("page", _UNITS, _MET) + "SELECT query_id, id, rank, round(score, 6) AS score FROM page")
def _(c):
    return _bm25(c, GRAMMAR).select("query_id", "id", _long("rank"), r6(F.col("score"), "score"))


@query("bm25_scoped", _INDEX + _page("page", *_all_of(SEARCHES), limit=100000) + "SELECT query_id, id, round(score, 6) AS score FROM (SELECT p.*, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, p.id) AS k FROM page p JOIN docs d USING (id) WHERE query_id <> 1 OR source_collection_id = 3) WHERE k <= 15")
def _(c):
    """A batch whose first query is limited to a collection."""
    scope = small(c.spark, [(q, 3 if q == 1 else None) for q, _ in SEARCHES], "query_id long, collection long")
    hits = index.search(c.index, _parsed([(q, " ".join(ts)) for q, ts in SEARCHES]), stemmed=False)
    hits = vectors.within(hits.join(c.active.select("id", "path", "source_collection_id"), "id"), scope)
    return fulltext.top_hits(hits, 15).select("query_id", "id", r6(F.col("score"), "score"))


_AFTER = ", changed AS (SELECT id, CASE WHEN id % 5 = 1 THEN 'changed words here' ELSE text END AS text FROM docs JOIN fts USING (id) WHERE id % 5 <> 0), words_ AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM changed)"


@query("index_update", _AFTER + " SELECT id, count(*) AS n, count(DISTINCT token) AS tokens FROM words_ GROUP BY id")
def _(c):
    """An index after documents were removed from it and others indexed anew."""
    ids = c.index.ids.withColumnRenamed("doc_id", "id")
    kept = index.remove(c.index, ids.where(F.col("id") % 5 == 0).select(F.col("id").alias("doc_id")))
    again = ids.where(F.col("id") % 5 == 1).select("id", F.lit("changed words here").alias("text"))
    made = index.replace(kept, again, {"body": F.col("text")})
    return made.postings.where("col = 'body'").groupBy(F.col("doc_id").alias("id")).agg(F.sum(F.size("positions")).alias("n"), F.count("*").alias("tokens"))


@query("fts_boolean", r", j AS (SELECT id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM docs WHERE active) SELECT id FROM j WHERE (contains(t, ' from ') OR contains(t, ' nicht ')) AND NOT contains(t, ' with ')")
def _(c):
    return c.active.where(fulltext.matches(fulltext.parse_query("(from OR nicht) NOT with"), F.col("text"))).select("id")


@query("fts_phrase", r", j AS (SELECT id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM docs WHERE active) SELECT id FROM j WHERE contains(t, ' of the ') AND contains(t, ' tion')")
def _(c):
    return c.active.where(fulltext.matches(fulltext.parse_query('"of the" tion*'), F.col("text"))).select("id")


# -- vectors

_KNN = f""", qv AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id IN {VECTOR_IDS}
), dist AS (SELECT q.query_id, v.vec_id, v.id, v.path, v.active, v.source_collection_id, list_distance(CAST(v.embedding AS DOUBLE[]), q.q) AS distance FROM vectors v, qv q
), near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id, id) AS k FROM dist) WHERE k <= 45
), best AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY round(distance, 9), vec_id, id) AS n FROM near WHERE active __WHERE__
), vpage AS (SELECT * FROM (SELECT query_id, path, id, 1 / (1 + distance) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id, id) - 1 AS rank FROM best WHERE n = 1) WHERE rank < 15)
"""


def query_vectors(c: Corpus) -> list[tuple[int, list[float]]]:
    """The stated query vectors: the embeddings of three ids."""
    return [(r["vec_id"], list(r["embedding"])) for r in c.table("embeddings").where(F.col("vec_id").isin(*VECTOR_IDS)).collect()]


@query("vector_search", _KNN.replace("__WHERE__", "") + "SELECT query_id, id, rank, round(score, 6) AS score FROM vpage")
def _(c):
    found = vectors.best_per_path(vectors.nearest_chunks(c.vectors, query_vectors(c), 45), 15)
    return found.select("query_id", "id", F.col("rank").cast("long").alias("rank"), r6(F.col("score"), "score"))


@query("vector_search_scoped", _KNN.replace("__WHERE__", "AND source_collection_id = 3") + "SELECT query_id, id, rank, round(score, 6) AS score FROM vpage")
def _(c):
    found = vectors.best_per_path(vectors.nearest_chunks(c.vectors, query_vectors(c), 45), 15, collection=3)
    return found.select("query_id", "id", F.col("rank").cast("long").alias("rank"), r6(F.col("score"), "score"))


# -- tags

_QTAGS = [(1, "fr", 1.0), (1, "topic-3", 0.5), (2, "en", 1.0), (2, "proj/src2", 1.0), (3, "es", 0.7)]
_TAGS = """, qt(query_id, tag, weight) AS (VALUES (1::BIGINT,'fr',1.0::DOUBLE),(1,'topic-3',0.5),(2,'en',1.0),(2,'proj/src2',1.0),(3,'es',0.7)
), th AS (SELECT q.query_id, t.document_id, sum(q.weight) AS s FROM tags t JOIN docs d ON d.id = t.document_id AND d.active JOIN qt q USING (tag) GROUP BY ALL
), tn AS (SELECT query_id, document_id, s / max(s) OVER (PARTITION BY query_id) AS score FROM th
), tpage AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, document_id) - 1 AS rank FROM tn) WHERE rank < 15)
"""


def _query_tags(c):
    return small(c.spark, _QTAGS, "query_id long, tag string, weight double")


@query("tag_search", _TAGS + "SELECT query_id, document_id, rank, round(score, 6) AS score FROM tpage")
def _(c):
    live = c.tags.join(c.active.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    top = fulltext.top_hits(tags.tag_hits(live, _query_tags(c)), 15, tie="document_id")
    return top.select("query_id", "document_id", F.col("rank").cast("long").alias("rank"), r6(F.col("score"), "score"))


@query("infer_tags", """, tk AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text || ' fr german EN fr'), '[a-z0-9_/-]+')) AS token, generate_subscripts(regexp_extract_all(lower(text || ' fr german EN fr'), '[a-z0-9_/-]+'), 1) - 1 AS place FROM conversations
), hit AS (SELECT conv_id * 1000 + turn AS query_id, place, CASE WHEN k.tag IS NOT NULL THEN token ELSE a.canonical END AS tag, CASE WHEN k.tag IS NOT NULL THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence
  FROM tk LEFT JOIN (SELECT DISTINCT tag FROM tags) k ON k.tag = token LEFT JOIN (VALUES ('english','en'),('french','fr'),('german','de'),('spanish','es'),('deutsch','de')) a(alias, canonical) ON a.alias = token)
SELECT query_id, tag, confidence, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, tag ORDER BY place, confidence DESC) AS n FROM hit WHERE tag IS NOT NULL) WHERE n = 1""")
def _(c):
    asked = c.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat("text", F.lit(" fr german EN fr")).alias("query"))
    return tags.infer(asked, c.tags.select("tag").distinct()).select("query_id", "tag", "confidence", F.col("at").cast("long").alias("place"))


@query(
    "infer_tags_prefix",
    """, known AS (SELECT DISTINCT tag FROM tags), tk AS (SELECT n_nationkey AS query_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS place FROM (SELECT n_nationkey, ['topic', 'german', 'fr', 'proj/src1', 'to', 'topic-3', lower(n_name)] AS w FROM nation)
), hit AS (SELECT query_id, place, coalesce(k.tag, a.canonical) AS tag, CASE WHEN k.tag IS NOT NULL THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence, token FROM tk LEFT JOIN known k ON k.tag = token LEFT JOIN (VALUES ('english','en'),('french','fr'),('german','de'),('spanish','es'),('deutsch','de')) a(alias, canonical) ON a.alias = token
), found_ AS (SELECT query_id, place, tag, confidence FROM hit WHERE tag IS NOT NULL UNION ALL SELECT h.query_id, h.place, k.tag, 0.7::DOUBLE FROM hit h JOIN known k ON starts_with(k.tag, h.token) WHERE h.tag IS NULL AND length(h.token) >= 3)
SELECT query_id, tag, confidence, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, place, tag) - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, tag ORDER BY place, confidence DESC) AS n FROM found_) WHERE n = 1""",
)
def _(c):
    """Prefixes too, and the matches ranked by confidence."""
    words_ = F.concat(F.lit("topic, German fr proj/src1 to topic-3 "), "n_name")
    asked = c.table("nation").select(F.col("n_nationkey").cast("long").alias("query_id"), words_.alias("query"))
    return tags.infer(asked, c.tags.select("tag").distinct(), prefix=True).select("query_id", "tag", "confidence", _long("rank"))


@query("tag_snippets", _TAGS + "SELECT query_id, document_id, rank, left(text, 200) AS snippet FROM tpage JOIN docs d ON d.id = document_id WHERE rank < 5 AND score >= 0.5")
def _(c):
    """Tag hits of a page with the first 200 characters of their texts, joined after the cut."""
    found = H.tag_list(c, _query_tags(c), 15).where((F.col("rank") < 5) & (F.col("score") >= 0.5))
    return found.join(c.documents.select(F.col("id").alias("document_id"), "text"), "document_id").select("query_id", "document_id", _long("rank"), F.substring("text", 1, 200).alias("snippet"))


@query("resolve_aliases", "SELECT n_nationkey, CASE lower(n_name) WHEN 'french' THEN 'fr' WHEN 'german' THEN 'de' ELSE lower(n_name) END AS tag FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'French' WHEN n_nationkey % 3 = 1 THEN 'GERMAN' ELSE n_name END AS n_name FROM nation)", views=False)
def _(c):
    name = F.when(F.col("n_nationkey") % 3 == 0, "French").when(F.col("n_nationkey") % 3 == 1, "GERMAN").otherwise(F.col("n_name"))
    return c.table("nation").select("n_nationkey", tags.resolve(name).alias("tag"))


_EDGES = ", edges(parent, child) AS (VALUES " + ", ".join(f"('{p}', '{x}')" for p, x in tags.load_ontology().pairs) + ")"
_UP = _EDGES + " SELECT * FROM (WITH RECURSIVE up(tag, ancestor, hop) AS (SELECT DISTINCT t.tag, e.parent, 1 FROM tags t JOIN edges e ON e.child = t.tag UNION ALL SELECT up.tag, e.parent, up.hop + 1 FROM up JOIN edges e ON e.child = up.ancestor WHERE up.hop < 10) SELECT tag, ancestor, hop FROM up)"


@query("ontology_ancestors", _UP)
def _(c):
    return tags.ancestors(c.tags.select("tag").distinct(), tags.load_ontology())


_CARRIED = "(SELECT tag AS {name}, count(*) AS n FROM tags GROUP BY 1)"


@query("ontology_descendants", _EDGES + " SELECT tag, descendant, hop, coalesce(n, 0) AS n FROM (WITH RECURSIVE down(tag, descendant, hop) AS (SELECT DISTINCT e.parent, e.child, 1 FROM edges e UNION ALL SELECT down.tag, e.child, down.hop + 1 FROM down JOIN edges e ON e.parent = down.descendant WHERE down.hop < 10) SELECT tag, descendant, hop FROM down) LEFT JOIN " + _CARRIED.format(name="descendant") + " USING (descendant)")
def _(c):
    """What lies below each tag of the ontology, and how many documents carry it."""
    known = tags.load_ontology()
    parents = small(c.spark, [(p,) for p in sorted({p for p, _ in known.pairs})], "tag string")
    below = tags.descendants(parents, known)
    return below.join(tags.frequency(c.tags).withColumnRenamed("tag", "descendant"), "descendant", "left").select("tag", "descendant", "hop", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("ontology_expand", _EDGES + ", own AS (SELECT DISTINCT document_id AS query_id, tag FROM tags), up AS (SELECT o.query_id, e.parent AS tag, 0.7::DOUBLE AS weight FROM own o JOIN edges e ON e.child = o.tag UNION ALL SELECT o.query_id, g.parent, 0.49::DOUBLE FROM own o JOIN edges e ON e.child = o.tag JOIN edges g ON g.child = e.parent) SELECT query_id, tag, round(max(weight), 6) AS weight FROM (SELECT query_id, tag, 1.0::DOUBLE AS weight FROM own UNION ALL SELECT * FROM up) GROUP BY ALL")
def _(c):
    own = c.tags.select(F.col("document_id").alias("query_id"), "tag").distinct()
    return tags.expand(own, tags.load_ontology()).select("query_id", "tag", r6(F.col("weight"), "weight"))


@query("tag_frequency", "SELECT tag, count(*) AS n FROM tags GROUP BY tag")
def _(c):
    return tags.frequency(c.tags)


@query("docs_with_any_tag", "SELECT DISTINCT document_id FROM tags WHERE tag IN ('fr', 'topic-1')")
def _(c):
    return tags.with_any(c.tags, ["fr", "topic-1"])


@query("docs_with_all_tags", "SELECT document_id FROM tags WHERE tag IN ('fr', 'topic-1') GROUP BY 1 HAVING count(DISTINCT tag) = 2")
def _(c):
    return tags.with_all(c.tags, ["fr", "topic-1"])


# -- fusion and scoring

_FUSE = _BM25 + _KNN.replace("__WHERE__", "") + """, lists AS (
  SELECT query_id, 0 AS list_idx, rank, 1.0 AS weight, 'fts' AS source, d.path AS filepath, score / min(score) OVER (PARTITION BY query_id) AS score FROM page JOIN docs d USING (id)
  UNION ALL SELECT CASE query_id WHEN 3 THEN 1::BIGINT WHEN 42 THEN 2 ELSE 3 END, 1, rank, 1.0, 'vec', path, score FROM vpage
), fused AS (
  SELECT query_id, filepath, sum(weight / (60 + rank + 1) + CASE WHEN rank = 0 THEN 0.05 WHEN rank <= 2 THEN 0.02 ELSE 0 END) AS score,
    max(score) FILTER (source = 'fts') AS fts_score, max(score) FILTER (source = 'vec') AS vec_score, min(rank) FILTER (source = 'fts') AS fts_rank, min(rank) FILTER (source = 'vec') AS vec_rank,
    count(DISTINCT source) AS sources_count, min(list_idx * 1000 + rank) AS first_seen
  FROM lists GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first_seen, filepath) - 1 AS pos FROM fused)
"""
_FUSE = _FUSE.replace("sum(weight", "sum(CAST(weight AS DOUBLE)")


def _lists(c):
    number = F.when(F.col("query_id") == 3, 1).when(F.col("query_id") == 42, 2).otherwise(3).cast("long")
    fts = H.text_list(c, _parsed([(q, " ".join(ts)) for q, ts in SEARCHES]), 15, stemmed=False)
    vec = H.vector_list(c, query_vectors(c), 15).withColumn("query_id", number)
    return H.as_list(fts, 0, 1.0, "fts").union(H.as_list(vec, 1, 1.0, "vec"))


def _ranked(c):
    return fusion.fuse(_lists(c), keep=["document_id"])


def _judged(ranked):
    """A stand-in judge that both engines can compute: a third of the documents, by path length."""
    n = F.length("filepath") % 3
    return ranked.where(n != 2).select("query_id", "filepath", F.when(n == 0, 0.95).otherwise(0.45).alias("rerank_score"))


_JUDGE = "CASE length(filepath) % 3 WHEN 0 THEN 0.95::DOUBLE WHEN 1 THEN 0.45::DOUBLE END"


@query("rrf_fusion", _FUSE + "SELECT query_id, pos, filepath, round(score, 6) AS score, round(fts_score, 6) AS fts_score, round(vec_score, 6) AS vec_score, coalesce(fts_rank, -1) AS fts_rank, coalesce(vec_rank, -1) AS vec_rank, sources_count FROM ranked")
def _(c):
    long = lambda x: F.coalesce(F.col(x).cast("long"), F.lit(-1).cast("long")).alias(x)
    return _ranked(c).select("query_id", long("pos"), "filepath", *[r6(F.col(x), x) for x in ("score", "fts_score", "vec_score")], long("fts_rank"), long("vec_rank"), "sources_count")


@query("rrf_representative", _FUSE + "SELECT query_id, filepath, d.id AS document_id, d.hash, r.source FROM (SELECT query_id, filepath, source, row_number() OVER (PARTITION BY query_id, filepath ORDER BY score DESC, list_idx, rank) AS k FROM lists) r JOIN docs d ON d.path = filepath WHERE k = 1")
def _(c):
    """The hit that stands for a fused document: the one of the highest score of its own."""
    best = fusion.fuse(_lists(c).withColumn("from", F.col("source")), keep=["document_id", "from"])
    return best.join(c.documents.select(F.col("id").alias("document_id"), "hash"), "document_id").select("query_id", "filepath", "document_id", "hash", F.col("from").alias("source"))


@query("rrf_default_weights", _FUSE + "SELECT query_id, filepath, round(sum(2.0::DOUBLE / (60 + rank + 1) + CASE WHEN rank = 0 THEN 0.05 WHEN rank <= 2 THEN 0.02 ELSE 0 END), 6) AS score FROM lists GROUP BY ALL")
def _(c):
    weights = F.array(*map(F.lit, fusion.default_weights(2)))
    return fusion.fuse(_lists(c).withColumn("weight", F.get(weights, F.col("list_idx")))).select("query_id", "filepath", r6(F.col("score"), "score"))


@query("rrf_inverse", _FUSE + "SELECT query_id, filepath, round(1 / score - 61, 6) AS rank_like FROM ranked")
def _(c):
    return _ranked(c).select("query_id", "filepath", r6(fusion.rrf_inverse(F.col("score")), "rank_like"))


@query("normalize_scores", _FUSE + "SELECT query_id, filepath, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM ranked")
def _(c):
    return fusion.max_normalize(_ranked(c)).select("query_id", "filepath", r6(F.col("score"), "score"))


@query("blend_scores", _FUSE + f"SELECT query_id, filepath, round(w * score + (1 - w) * coalesce(j, 0.5), 6) AS score, w AS blend_weight FROM (SELECT *, CASE WHEN pos < 3 THEN 0.75::DOUBLE WHEN pos < 10 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS w, {_JUDGE} AS j FROM ranked)")
def _(c):
    ranked = _ranked(c)
    return fusion.blend(ranked, _judged(ranked)).select("query_id", "filepath", r6(F.col("score"), "score"), "blend_weight")


@query("simple_blend", _FUSE + f"SELECT query_id, filepath, round(coalesce(0.6::DOUBLE * score + 0.4::DOUBLE * {_JUDGE}, score), 6) AS score FROM ranked")
def _(c):
    ranked = _ranked(c)
    return fusion.simple_blend(ranked, _judged(ranked)).select("query_id", "filepath", r6(F.col("score"), "score"))


@query("rerank_top_k", _FUSE + f"SELECT query_id, filepath, pos FROM (SELECT query_id, filepath, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(0.6::DOUBLE * score + 0.4::DOUBLE * {_JUDGE}, score), 9) DESC, pos) - 1 AS pos FROM ranked) WHERE pos < 4")
def _(c):
    ranked = _ranked(c)
    return fusion.simple_blend(ranked, _judged(ranked), top_k=4).select("query_id", "filepath", _long("pos"))


@query("weighted_score", "SELECT l_orderkey, l_linenumber, round((l_discount * 2 + l_tax) / 3, 6) AS score FROM lineitem", views=False)
def _(c):
    return c.table("lineitem").select("l_orderkey", "l_linenumber", r6(fusion.weighted_average(F.col("l_discount"), F.col("l_tax"), 2, 1), "score"))


@query("confidence_score", "SELECT event_id, round(CASE WHEN abs(p - s) <= 0.2 THEN least(1.0, p + 0.1 * (1 - abs(p - s))) ELSE p * (1 - abs(p - s)) END, 6) AS score FROM (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS p, (event_id % 37) / 36.0::DOUBLE AS s FROM events)", views=False)
def _(c):
    p, s = (F.col("event_id") % 101) / 100.0, (F.col("event_id") % 37) / 36.0
    return c.table("events").select("event_id", r6(fusion.confidence(p, s), "score"))


@query("tag_boost_v1", _FUSE + ", m AS (SELECT r.query_id, r.filepath, count(t.tag) AS n FROM ranked r JOIN docs d ON d.path = r.filepath LEFT JOIN tags t ON t.document_id = d.id AND t.tag IN ('fr', 'en', 'topic-3', 'proj/src2') GROUP BY ALL) SELECT query_id, filepath, round(score * CASE WHEN n >= 1 THEN least(2.0, 1 + 0.3::DOUBLE * (1 + 0.5 * (n - 1))) ELSE 1 END, 6) AS score FROM ranked JOIN m USING (query_id, filepath)")
def _(c):
    asked = ["fr", "en", "topic-3", "proj/src2"]
    held = c.tags.where(F.col("tag").isin(asked)).groupBy("document_id").agg(F.count("*").alias("n"))
    ranked = _ranked(c).join(held, "document_id", "left")
    return ranked.select("query_id", "filepath", r6(F.col("score") * fusion.boost_by_count(F.coalesce("n", F.lit(0))), "score"))


@query("tag_boost_v2", _FUSE + _TAGS + ", m AS (SELECT r.query_id, r.filepath, sum(q.weight) AS w FROM ranked r JOIN docs d ON d.path = r.filepath JOIN tags t ON t.document_id = d.id JOIN qt q ON q.tag = t.tag AND q.query_id = r.query_id GROUP BY ALL) SELECT query_id, filepath, round(score * CASE WHEN w > 0 THEN least(pow(1.15::DOUBLE, w), 2.0) ELSE 1 END, 6) AS score FROM ranked LEFT JOIN m USING (query_id, filepath)")
def _(c):
    return H.boosted(_ranked(c), c.tags, _query_tags(c), 1.15, 2.0).select("query_id", "filepath", r6(F.col("score"), "score"))


@query("rerank_confidence", _FUSE + f"SELECT query_id, round(avg(CASE WHEN {_JUDGE} > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS confidence FROM ranked WHERE {_JUDGE} IS NOT NULL GROUP BY 1")
def _(c):
    judged = _judged(_ranked(c))
    return judged.groupBy("query_id").agg(r6(F.coalesce(F.avg((F.col("rerank_score") > 0.5).cast("double")), F.lit(0.5)), "confidence"))


_MIX = _FUSE + _TAGS + """, all_lists AS (
  SELECT query_id, list_idx, rank, 1.0::DOUBLE AS weight, source, filepath, score FROM lists
  UNION ALL SELECT query_id, 2, rank, 0.8::DOUBLE, 'tag', d.path, score FROM tpage JOIN docs d ON d.id = document_id
), mixed AS (
  SELECT query_id, filepath, sum(weight / (60 + rank + 1) + CASE WHEN rank = 0 THEN 0.05 WHEN rank <= 2 THEN 0.02 ELSE 0 END) AS score, count(DISTINCT source) AS sources_count, min(list_idx * 1000 + rank) AS first_seen FROM all_lists GROUP BY ALL
), cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first_seen, filepath) - 1 AS pos FROM mixed) WHERE pos < 30
), bw AS (SELECT r.query_id, r.filepath, sum(q.weight) AS w FROM cut r JOIN docs d ON d.path = r.filepath JOIN tags t ON t.document_id = d.id JOIN qt q ON q.tag = t.tag AND q.query_id = r.query_id GROUP BY ALL
), boosted AS (SELECT c.query_id, c.filepath, c.sources_count, c.pos, c.score * CASE WHEN w > 0 THEN least(pow(1.15::DOUBLE, w), 2.0) ELSE 1 END AS score FROM cut c LEFT JOIN bw USING (query_id, filepath)
), norm AS (SELECT *, score / max(score) OVER (PARTITION BY query_id) AS s FROM boosted)
SELECT query_id, file, pos, score, sources_count FROM (SELECT query_id, filepath AS file, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, pos) - 1 AS pos, round(s, 6) AS score, s, sources_count FROM norm) WHERE pos < 5"""


def _mixed(c, config: H.SearchConfig):
    third = H.as_list(H.tag_list(c, _query_tags(c), 15), 2, 0.8, "tag")
    fused = fusion.fuse(_lists(c).union(third), keep=["document_id"]).where(F.col("pos") < config.candidates)
    ranked = fusion.resort(H.boosted(fused, c.tags, _query_tags(c), config.boost_factor, config.boost_cap))
    return H.finish(ranked, config).select("query_id", "file", _long("pos"), r6(F.col("score"), "score"), "sources_count")


@query("hybrid_search", _MIX)
def _(c):
    """Full text, vectors and tags of a batch of queries, fused, boosted, normalised and cut. Reads
    the stored index and no text."""
    return _mixed(c, H.SearchConfig())


@query("hybrid_min_score", _MIX + " AND s >= 0.8")
def _(c):
    return _mixed(c, H.SearchConfig(min_score=0.8))


_ASKED = [(1, ["from", "with", "en"]), (2, ["nicht", "das", "german"]), (3, ["pour", "french"])]
_EXPANDED = (
    _INDEX
    + _page("t0", *_all_of(_ASKED))
    + _page("t3", *_all_of([(1, ["from"]), (2, ["das"])]))
    + _page("t4", *_all_of([(1, ["with"])]))
    + _KNN.replace("__WHERE__", "")
    + _EDGES
    + """, found(query_id, tag) AS (VALUES (1::BIGINT, 'en'), (2, 'de'), (3, 'fr')
), qt AS (SELECT query_id, tag, max(weight) AS weight FROM (SELECT query_id, tag, 1.0::DOUBLE AS weight FROM found UNION ALL SELECT query_id, e.parent, 0.7::DOUBLE FROM found JOIN edges e ON e.child = tag UNION ALL SELECT query_id, g.parent, 0.49::DOUBLE FROM found JOIN edges e ON e.child = tag JOIN edges g ON g.child = e.parent) GROUP BY ALL
), tw AS (SELECT q.query_id, t.document_id, sum(q.weight) AS w FROM tags t JOIN qt q USING (tag) GROUP BY ALL
), tn AS (SELECT query_id, document_id, w / max(w) OVER (PARTITION BY query_id) AS score FROM tw JOIN docs d ON d.id = document_id AND d.active
), tpage AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, document_id) - 1 AS rank FROM tn) WHERE rank < 15
), every AS (SELECT query_id, 0 AS list_idx, rank, 1.0::DOUBLE AS weight, 'fts' AS source, id FROM t0 UNION ALL SELECT query_id, 3, rank, 0.5::DOUBLE, 'fts', id FROM t3 UNION ALL SELECT query_id, 4, rank, 0.5::DOUBLE, 'fts', id FROM t4
  UNION ALL SELECT CASE query_id WHEN 3 THEN 1::BIGINT WHEN 42 THEN 2 ELSE 3 END, 1, rank, 1.0::DOUBLE, 'vec', id FROM vpage UNION ALL SELECT query_id, 2, rank, 0.8::DOUBLE, 'tag', document_id FROM tpage
), cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first_seen, path) - 1 AS pos FROM (SELECT query_id, e.id, d.path, sum(weight / (60 + rank + 1) + CASE WHEN rank = 0 THEN 0.05 WHEN rank <= 2 THEN 0.02 ELSE 0 END) AS score, count(DISTINCT e.source) AS sources_count, min(list_idx * 1000 + rank) AS first_seen FROM every e JOIN docs d USING (id) GROUP BY ALL)) WHERE pos < 30
), raised AS (SELECT c.*, c.score * CASE WHEN w > 0 THEN least(pow(1.15::DOUBLE, w), 2.0) ELSE 1 END AS b FROM cut c LEFT JOIN tw ON tw.query_id = c.query_id AND tw.document_id = c.id
), norm AS (SELECT *, b / max(b) OVER (PARTITION BY query_id) AS s FROM raised)
SELECT query_id, file, pos, score, sources_count FROM (SELECT query_id, path AS file, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, round(b, 9) DESC, pos) - 1 AS pos, round(s, 6) AS score, sources_count FROM norm) WHERE pos < 5"""
)


@query("hybrid_search_expanded", _EXPANDED)
def _(c):
    """The whole plan with expanded variants and inferred tags, as the engine composes it."""
    vector = {q: tuple(v) for q, v in query_vectors(c)}
    asked = [H.Query(1, "from with en", vector[3], ("from", "with")), H.Query(2, "nicht das german", vector[42], ("das",)), H.Query(3, "pour french", vector[77])]
    return H.hybrid(c, asked, H.SearchConfig(stemmed=False)).select("query_id", _long("pos"), "file", r6(F.col("score"), "score"), "sources_count")


# -- index upkeep


@query("docs_missing_fts", "SELECT id, path FROM docs WHERE active AND id NOT IN (SELECT id FROM fts)")
def _(c):
    return store.orphans(c.active, c.fts_ids, ["id"]).select("id", "path")


@query("docs_missing_embeddings", "SELECT id, path FROM docs WHERE active AND hash NOT IN (SELECT hash FROM vectors)")
def _(c):
    return store.orphans(c.active, c.vectors.select("hash"), ["hash"]).select("id", "path")


@query("orphan_fts", "SELECT id FROM fts WHERE id NOT IN (SELECT id FROM docs WHERE active)")
def _(c):
    return store.orphans(c.fts_ids, c.active.select("id"), ["id"])


@query("orphan_vectors", "SELECT vec_id, hash FROM vectors WHERE hash NOT IN (SELECT hash FROM docs WHERE active)")
def _(c):
    return store.orphans(c.vectors, c.active.select("hash"), ["hash"]).select("vec_id", "hash")


@query("orphan_content", "SELECT hash FROM content WHERE hash NOT IN (SELECT hash FROM docs WHERE active)")
def _(c):
    return store.orphans(c.content, c.active.select("hash"), ["hash"]).select("hash")


@query("embedding_coverage", "SELECT source_collection_id, count(*) AS docs, count(*) FILTER (hash IN (SELECT hash FROM vectors)) AS embedded, count(DISTINCT hash) AS hashes FROM docs WHERE active GROUP BY 1")
def _(c):
    have = c.vectors.select("hash").distinct().withColumn("_v", F.lit(1))
    both = c.active.join(have, "hash", "left")
    return both.groupBy("source_collection_id").agg(F.count("*").alias("docs"), F.count("_v").alias("embedded"), F.count_distinct("hash").alias("hashes"))


@query("backfill_targets", "SELECT d.id, d.path, length(c.doc) AS n FROM docs d JOIN content c USING (hash) WHERE d.active AND d.id % 3 <> 0")
def _(c):
    done = c.documents.where(F.col("id") % 3 == 0).select("id")
    return store.orphans(c.active.join(c.content, "hash"), done, ["id"]).select("id", "path", F.length("doc").cast("long").alias("n"))


@query("embed_targets", "SELECT hash, min(path) AS path FROM docs WHERE active AND hash NOT IN (SELECT hash FROM vectors) AND trim(text) <> '' GROUP BY 1")
def _(c):
    left = store.orphans(c.active.where(T.is_indexable(F.col("text"))), c.vectors.select("hash"), ["hash"])
    return left.groupBy("hash").agg(F.min("path").alias("path"))


_LISTING = ", listing AS (SELECT path, sha256(CASE WHEN id % 17 = 0 THEN text || '!' ELSE text END) AS hash FROM docs WHERE id % 13 <> 0 UNION ALL SELECT 'new/' || id || '.md', hash FROM docs WHERE id % 50 = 0)"


def _listing(c):
    kept = c.documents.where(F.col("id") % 13 != 0).select("path", F.sha2(F.when(F.col("id") % 17 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return kept.union(c.documents.where(F.col("id") % 50 == 0).select(F.concat(F.lit("new/"), F.col("id").cast("string"), F.lit(".md")), "hash"))


@query("change_detection", _LISTING + " SELECT l.path, CASE WHEN d.path IS NULL THEN 'new' WHEN d.hash <> l.hash THEN 'modified' ELSE 'unchanged' END AS change FROM listing l LEFT JOIN docs d USING (path)")
def _(c):
    return store.changes(c.documents, _listing(c))


@query("stale_paths", _LISTING + " SELECT path FROM docs WHERE active AND path NOT IN (SELECT path FROM listing)")
def _(c):
    return store.stale(c.documents, _listing(c)).select("path")


@query("upsert_documents", _LISTING + " SELECT path, hash, active, is_new FROM (SELECT d.path, coalesce(l.hash, d.hash) AS hash, (d.active OR l.path IS NOT NULL) AS active, false AS is_new FROM docs d LEFT JOIN listing l USING (path) UNION ALL SELECT l.path, l.hash, true, true FROM listing l WHERE l.path NOT IN (SELECT path FROM docs))")
def _(c):
    base = lambda d: d.withColumn("source_collection_id", F.lit(1).cast("long")).withColumn("title", F.col("path")).withColumn("modified_at", F.lit(NOW).cast("timestamp_ntz"))
    stored = base(c.documents).select("id", "source_collection_id", "path", "title", "hash", "active", "modified_at")
    return store.upsert_documents(stored, base(_listing(c))).select("path", "hash", "active", "is_new")


@query("soft_delete", "SELECT id, (active AND id % 13 <> 0) AS active FROM docs")
def _(c):
    return store.soft_delete(c.documents, c.documents.where(F.col("id") % 13 == 0)).select("id", "active")


@query("remove_collection", "SELECT hash FROM content WHERE hash IN (SELECT hash FROM docs WHERE source_collection_id <> 3)")
def _(c):
    return store.remove_collection(c.documents, c.content, 3)[1].select("hash")


@query("index_status", "SELECT count(*) FILTER (active) AS active_docs, count(*) AS docs, count(DISTINCT hash) AS hashes, (SELECT count(*) FROM vectors) AS vectors, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM docs")
def _(c):
    total = c.documents.agg(F.count_if("active").alias("active_docs"), F.count("*").alias("docs"), F.count_distinct("hash").alias("hashes"), F.sum(F.length("text")).alias("n_chars"))
    return total.crossJoin(c.vectors.agg(F.count("*").alias("vectors")))  # single rows


_SAMPLE = "SELECT '{name}' AS issue, count(*) AS n, array_to_string(list_sort(list(label ORDER BY label)[1:20]), ',') AS samples FROM (SELECT {label} AS label {rows})"


@query(
    "sync_report",
    " UNION ALL ".join(
        [
            _SAMPLE.format(name="missing_fts", label="path", rows="FROM docs WHERE active AND id NOT IN (SELECT id FROM fts)"),
            _SAMPLE.format(name="missing_embeddings", label="path", rows="FROM docs WHERE active AND hash NOT IN (SELECT hash FROM vectors)"),
            _SAMPLE.format(name="orphan_fts", label="path", rows="FROM docs WHERE NOT active AND id IN (SELECT id FROM fts)"),
            _SAMPLE.format(name="orphan_embeddings", label="hash", rows="FROM (SELECT DISTINCT hash FROM vectors WHERE hash NOT IN (SELECT hash FROM docs WHERE active))"),
        ]
    ),
)
def _(c):
    """Counts of what the indexes lack or have too much, each with its first 20 samples."""
    found = upkeep.sync_report(c.documents, c.fts_ids.withColumnRenamed("id", "doc_id"), c.vectors)
    return found.select("issue", "n", F.array_join("samples", ",").alias("samples"))


@query("search_over_segments", _INDEX.replace("fts USING (id)", "seg_docs s USING (id)").replace("d.text", "s.text").replace(", raw AS", """, seg_docs AS (SELECT id, CASE WHEN id % 5 = 1 THEN text || ' from with' ELSE text END AS text FROM docs WHERE id % 7 <> 0 AND id % 5 <> 0 UNION ALL SELECT id, text FROM docs WHERE id % 7 = 0 AND id % 2 = 0), raw AS""", 1) + _page("page", *_all_of(SEARCHES)) + "SELECT query_id, id, rank, round(score, 6) AS score FROM page")
def _(c):
    """Search over an index of three segments: the stored one, one that indexes some of its documents
    anew, and one of further documents; and two delete sets. Scores are those of an index built afresh."""
    first, docs = _stored(c), c.documents
    columns = {"path": F.col("path"), "body": F.col("text")}
    again = index.build(docs.where("id % 7 <> 0 AND id % 5 = 1").withColumn("text", F.concat("text", F.lit(" from with"))), columns)
    more = index.build(docs.where("id % 7 = 0 AND id % 2 = 0"), columns)
    deletes = c.fts_ids.where("id % 5 = 1").select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("seg")).union(c.fts_ids.where("id % 5 = 0").select("id", F.lit(2).cast("long")))
    parts = [(first["postings"], first["lengths"], 0), (again.postings, again.lengths, 1), (more.postings, more.lengths, 2)]
    postings, lengths = (reduce(DataFrame.unionByName, [p[k].withColumn("seg", F.lit(p[2]).cast("long")) for p in parts]) for k in (0, 1))
    whole = index.Index(postings, lengths, deletes=deletes)
    hits = index.search(whole, _parsed([(q, " ".join(ts)) for q, ts in SEARCHES]), stemmed=False).join(c.active.select("id"), "id")
    return fulltext.top_hits(hits, 15).select("query_id", "id", _long("rank"), r6(F.col("score"), "score"))


# -- answers


@query("rag_context", _FUSE + "SELECT query_id, sha256(string_agg('[' || (pos + 1) || '] ' || filepath || ':' || chr(10) || left(d.text, 1000), chr(10) || chr(10) ORDER BY pos)) AS context_hash FROM ranked JOIN docs d ON d.path = filepath WHERE pos < 5 GROUP BY 1")
def _(c):
    top = _ranked(c).where(F.col("pos") < 5).join(c.documents.select(F.col("id").alias("document_id"), "text"), "document_id")
    part = F.concat(F.lit("["), (F.col("pos") + 1).cast("string"), F.lit("] "), "filepath", F.lit(":\n"), F.substring("text", 1, 1000))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))), lambda x: x["part"]), "\n\n")  # five rows a query
    return top.groupBy("query_id").agg(F.sha2(joined, 256).alias("context_hash"))


@query("chat_history_trim", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4", views=False)
def _(c):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return c.table("conversations").withColumn("n", F.row_number().over(w)).where(F.col("n") <= 4).select("conv_id", "turn", "role")


# -- pipelines over stored tables

_AT = "timestamp_ntz'2024-06-01 00:00:00'"
_STORED = """, old AS (SELECT id, path, hash, active, CASE WHEN id % 2 = 0 THEN '2024-01-01 00:00:00' END AS stored_time FROM docs
), listing AS (SELECT id, path, id % 23 = 3 AS failed, CASE WHEN id % 23 = 3 THEN NULL WHEN id % 17 = 0 THEN text || '!' ELSE text END AS text, CASE WHEN id % 4 = 2 THEN '2024-05-05 00:00:00' ELSE '2024-01-01 00:00:00' END AS t FROM docs WHERE id % 13 <> 0
  UNION ALL SELECT id, 'new/' || id || '.md', false, d.text, '2024-05-05 00:00:00' FROM decorated d WHERE id % 50 = 0
), seen AS (SELECT l.*, o.id AS old_id, CASE WHEN failed THEN 'error' WHEN o.id IS NULL OR NOT o.active THEN 'new' WHEN o.stored_time = l.t THEN 'unchanged_time' WHEN o.hash = sha256(l.text) THEN 'unchanged_hash' ELSE 'modified' END AS change FROM listing l LEFT JOIN old o USING (path)
), loaded AS (SELECT * FROM seen WHERE change IN ('new', 'modified')
), gone AS (SELECT path FROM old WHERE active AND path NOT IN (SELECT path FROM listing))
"""


def _stored(c: Corpus) -> upkeep.Tables:
    """The driver's tables as a store of one collection: odd documents lack a modification time, a
    third have no metadata."""
    at = F.expr(_AT)
    d = c.documents
    made = d.select(
        "id", F.lit(1).cast("long").alias("source_collection_id"), "path", F.col("path").alias("title"), "hash", "active", at.alias("modified_at"), F.lit(None).cast("string").alias("source_uri"), F.lit(None).cast("string").alias("etag"),
        F.when(F.col("id") % 2 == 0, "2024-01-01 00:00:00").alias("last_modified"), F.lit(None).cast("timestamp_ntz").alias("last_fetched_at"), F.lit(None).cast("int").alias("fetch_duration_ms"), F.lit(None).cast("int").alias("http_status"), F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("map<string,string>").alias("extra_metadata"),
    )
    tagged = c.tags.groupBy(F.col("document_id")).agg(F.array_sort(F.collect_set("tag")).alias("tags")).where(F.col("document_id") % 3 != 0)  # three tags a document
    return upkeep.Tables({
        "documents": lambda: made,
        "content": lambda: c.content.select("hash", "doc", at.alias("created_at")),
        "postings": lambda: c.index.postings.withColumn("seg", F.lit(0).cast("long")),
        "lengths": lambda: c.index.lengths.withColumn("seg", F.lit(0).cast("long")),
        "index_deletes": lambda: small(c.spark, [], TABLES["index_deletes"]),
        "index_totals": lambda: c.index.totals,
        "content_vectors": lambda: c.vectors.select("hash", "seq", F.lit(0).cast("long").alias("pos"), F.lit("m").alias("model"), at.alias("embedded_at"), "embedding"),
        "document_metadata": lambda: tagged.select("document_id", F.lit("generic").alias("profile"), "tags", F.col("tags").alias("source_tags"), F.lit("{}").alias("attributes"), at.alias("extracted_at")),
        "document_tags": lambda: c.tags,
        "source_collections": lambda: small(c.spark, [], TABLES["source_collections"]),
    })


def _found(c: Corpus) -> DataFrame:
    """A listing of that collection: missing, failed, changed, untouched and new files."""
    d = c.documents.where(F.col("id") % 13 != 0)
    failed = F.col("id") % 23 == 3
    text = F.when(failed, F.lit(None)).when(F.col("id") % 17 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    time = F.when(F.col("id") % 4 == 2, "2024-05-05 00:00:00").otherwise("2024-01-01 00:00:00")
    old = d.select("path", time.alias("mtime"), text.alias("text"), F.when(failed, "not valid UTF-8").alias("error"))
    new = c.decorated.where(F.col("id") % 50 == 0).select(F.concat(F.lit("new/"), F.col("id").cast("string"), F.lit(".md")).alias("path"), F.lit("2024-05-05 00:00:00").alias("mtime"), "text", F.lit(None).cast("string").alias("error"))
    both = old.union(new)
    return both.select(F.concat(F.lit("file:///in/"), "path").alias("uri"), "path", F.octet_length("text").cast("long").alias("size"), F.col("mtime").cast("timestamp").alias("mtime"), F.lit("text/markdown").alias("content_type"), "text", "error")


def _ingested(c: Corpus, **options) -> upkeep.Run:
    return upkeep.ingest(_stored(c), _found(c), 1, F.expr(_AT), **options)


@query("ingest_summary", _STORED + "SELECT count(*) FILTER (change IN ('new', 'modified')) AS indexed, count(*) FILTER (starts_with(change, 'unchanged')) AS skipped, count(*) FILTER (change = 'error') AS errors, (SELECT count(*) FROM gone) AS stale FROM seen")
def _(c):
    return _ingested(c).summary


@query(
    "ingest_documents",
    _STORED
    + """SELECT o.path, coalesce(sha256(l.text), o.hash) AS hash, CASE WHEN l.path IS NOT NULL THEN true WHEN o.path IN (SELECT path FROM gone) THEN false ELSE o.active END AS active, coalesce(CAST(s.change IN ('new', 'modified', 'unchanged_hash') AS VARCHAR), '-') AS fetched, CASE WHEN starts_with(l.text, '---') THEN 'Doc' ELSE 'path' END AS title
FROM old o LEFT JOIN loaded l USING (path) LEFT JOIN seen s USING (path) UNION ALL SELECT path, sha256(text), true, 'true', 'Doc' FROM loaded WHERE old_id IS NULL""",
)
def _(c):
    after = _ingested(c).tables["documents"]
    seen = _found(c).select("path").withColumn("_seen", F.lit(True))
    told = F.when(F.col("_seen"), F.col("last_fetched_at").isNotNull().cast("string")).otherwise("-")
    return after.join(seen, "path", "left").select("path", "hash", "active", told.alias("fetched"), F.when(F.col("title").startswith("Doc "), "Doc").otherwise("path").alias("title"))


@query("ingest_content", _STORED + "SELECT hash FROM content UNION SELECT sha256(text) FROM loaded")
def _(c):
    return _ingested(c).tables["content"].select("hash")


@query(
    "ingest_index",
    _STORED
    + """, kept AS (SELECT d.path, d.text FROM docs d JOIN fts USING (id) WHERE d.path NOT IN (SELECT path FROM loaded) AND d.active AND d.path NOT IN (SELECT path FROM gone)
), now_ AS (SELECT * FROM kept UNION ALL SELECT path, text FROM loaded WHERE trim(text, ' ' || chr(10)) <> '') SELECT path, CAST(len(regexp_extract_all(lower(path), '[\\p{L}\\p{N}]+')) + len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS BIGINT) AS dl FROM now_""",
)
def _(c):
    run = _ingested(c)
    return run.tables["lengths"].join(run.tables["documents"].select(F.col("id").alias("doc_id"), "path"), "doc_id").select("path", _long("dl"))


@query(
    "ingest_tags",
    _STORED
    + """SELECT d.path, t.tag FROM tags t JOIN docs d ON d.id = t.document_id WHERE d.path NOT IN (SELECT path FROM loaded)
UNION ALL SELECT DISTINCT l.path, unnest([d.lang, d.lang || '/' || d.source, 'proj', 'proj/' || d.source]) FROM loaded l JOIN docs d USING (id) WHERE starts_with(l.text, '---')""",
)
def _(c):
    run = _ingested(c)
    return run.tables["document_tags"].join(run.tables["documents"].select(F.col("id").alias("document_id"), "path"), "document_id").select("path", "tag")


@query("ingest_forced", _STORED + "SELECT count(*) FILTER (NOT failed) AS indexed, 0::BIGINT AS skipped, count(*) FILTER (failed) AS errors, (SELECT count(*) FROM gone) AS stale FROM seen")
def _(c):
    return _ingested(c, force=True).summary


@query("files_touched", _STORED + "SELECT coalesce(o.path, l.path) AS path, o.path IS NULL OR l.path IS NULL OR o.stored_time IS NULL OR o.stored_time <> l.t AS touched FROM old o FULL JOIN listing l USING (path)")
def _(c):
    """By modification time alone, before a text is read."""
    stored = _stored(c)["documents"].select("path", F.col("last_modified").cast("timestamp").alias("mtime"))
    return store.touched(stored, _found(c))


_WANTED = """, wanted AS (SELECT hash, count(*) AS copies FROM docs WHERE active AND hash NOT IN (SELECT hash FROM vectors) GROUP BY 1
), to_chunk AS (SELECT w.hash AS key, c.doc AS text FROM wanted w JOIN content c USING (hash))"""


@query("embed_summary", _WANTED + CHUNKS + "SELECT count(DISTINCT key) AS embedded, (SELECT count(*) FROM docs WHERE active AND hash IN (SELECT hash FROM vectors)) + (SELECT CAST(coalesce(sum(copies - 1), 0) AS BIGINT) FROM wanted WHERE hash IN (SELECT key FROM chunks)) AS skipped, count(*) AS chunks FROM chunks")
def _(c):
    return upkeep.embed(_stored(c), F.expr(_AT), "hashing").summary


@query("embed_vectors", _WANTED + CHUNKS + "SELECT hash, CAST(seq AS BIGINT) AS seq, 0::BIGINT AS pos, 'm' AS model, 64::BIGINT AS dim FROM vectors UNION ALL SELECT key, seq, pos, 'hashing', 64 FROM chunks")
def _(c):
    made = upkeep.embed(_stored(c), F.expr(_AT), "hashing").tables["content_vectors"]
    return made.select("hash", _long("seq"), "pos", "model", F.size("embedding").cast("long").alias("dim"))


@query("delete_vectors", "SELECT hash, CAST(seq AS BIGINT) AS seq FROM vectors WHERE vec_id % 2 = 0 AND hash NOT IN (SELECT hash FROM docs WHERE id % 10 = 1)")
def _(c):
    """Vectors without one model's and without those of some hashes."""
    v = c.vectors.withColumn("model", F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b"))
    return store.delete_rows(store.delete_model(v, "b"), c.documents.where(F.col("id") % 10 == 1), ["hash"]).select("hash", _long("seq"))


@query("replace_vectors", "SELECT hash, CAST(seq AS BIGINT) AS seq, 'old' AS model FROM vectors WHERE (hash, seq) NOT IN (SELECT (hash, seq) FROM vectors WHERE vec_id % 3 = 0) UNION ALL SELECT DISTINCT hash, CAST(seq AS BIGINT), 'new' FROM vectors WHERE vec_id % 3 = 0")
def _(c):
    """Vectors stored again by hash and place: the last write counts."""
    v = c.vectors.select("vec_id", "hash", "seq")
    new = v.where(F.col("vec_id") % 3 == 0).select("hash", "seq", F.lit("new").alias("model"))
    return store.replace_rows(v.select("hash", "seq", F.lit("old").alias("model")), new, ["hash", "seq"]).select("hash", _long("seq"), "model")


@query(
    "cleanup_summary",
    _INDEX + """, live AS (SELECT * FROM docs WHERE active) SELECT 'content' AS "table", count(*) AS removed FROM content WHERE hash NOT IN (SELECT hash FROM live) UNION ALL SELECT 'content_vectors', count(*) FROM vectors WHERE hash NOT IN (SELECT hash FROM live)
UNION ALL SELECT 'lengths', count(*) FROM fts WHERE id NOT IN (SELECT id FROM live) UNION ALL SELECT 'postings', count(*) FROM (SELECT DISTINCT id, col, term FROM pos) WHERE id NOT IN (SELECT id FROM live) UNION ALL SELECT 'document_metadata', count(*) FROM docs WHERE id % 3 <> 0 AND NOT active UNION ALL SELECT 'document_tags', count(*) FROM tags WHERE document_id NOT IN (SELECT id FROM live)""",
)
def _(c):
    return upkeep.cleanup(_stored(c)).summary


@query("cleanup_metadata", "SELECT id AS document_id FROM docs WHERE id % 3 <> 0 AND active")
def _(c):
    return upkeep.cleanup(_stored(c)).tables["document_metadata"].select("document_id")


@query("backfill_summary", "SELECT count(*) AS processed, count(*) FILTER (text <> '') AS updated, count(*) FILTER (text = '') AS skipped FROM docs WHERE active AND id % 3 = 0")
def _(c):
    return upkeep.backfill(_stored(c), F.expr(_AT)).summary


@query("backfill_metadata", "SELECT id AS document_id, CASE WHEN id % 3 <> 0 THEN 3 ELSE 0 END::BIGINT AS n_tags FROM docs WHERE id % 3 <> 0 OR (active AND text <> '')")
def _(c):
    made = upkeep.backfill(_stored(c), F.expr(_AT)).tables["document_metadata"]
    return made.select("document_id", F.size("tags").cast("long").alias("n_tags"))


@query("backfill_tags", "SELECT document_id, tag FROM tags WHERE document_id NOT IN (SELECT id FROM docs WHERE active AND id % 3 = 0 AND text <> '')")
def _(c):
    return upkeep.backfill(_stored(c), F.expr(_AT)).tables["document_tags"]


@query("store_status", "SELECT 0::BIGINT AS collections, count(*) FILTER (active) AS documents, count(DISTINCT hash) FILTER (active) AS hashes, count(*) FILTER (active AND hash IN (SELECT hash FROM vectors)) AS embedded, (SELECT CAST(sum(strlen(doc)) AS BIGINT) FROM content) AS content_bytes, (SELECT count(*) FROM vectors) AS vectors, (SELECT count(*) FROM fts) AS indexed FROM docs")
def _(c):
    return upkeep.status(_stored(c))


def _named(c: Corpus) -> DataFrame:
    """The nations as source collections."""
    at = F.expr(_AT)
    return c.table("nation").select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("/in/"), "n_name").alias("pwd"), F.array(F.lit("**/*.md")).alias("glob_patterns"), F.lit("filesystem").alias("source_type"), F.create_map(F.lit("glob_patterns"), F.lit("**/*.md")).alias("source_config"), at.alias("created_at"), at.alias("updated_at")
    )


@query(
    "collection_changes",
    "SELECT id, name, pwd, array_to_string(patterns, ' ') AS patterns, place FROM (SELECT *, row_number() OVER (ORDER BY name) - 1 AS place FROM (SELECT CAST(n_nationkey AS BIGINT) AS id, CASE n_name WHEN 'NATION_6' THEN 'HEXAGON' ELSE n_name END AS name, CASE n_name WHEN 'NATION_16' THEN '/moved' ELSE '/in/' || n_name END AS pwd, CASE n_name WHEN 'NATION_16' THEN ['*.txt', '!x/**'] ELSE ['**/*.md'] END AS patterns FROM nation UNION ALL SELECT CAST(max(n_nationkey) + 1 AS BIGINT), 'ATLANTIS', '/sea', ['**/*.md'] FROM nation))",
    views=False,
)
def _(c):
    """Collections after one was added, one renamed and one moved, by name."""
    at = F.expr(_AT)
    made = collections.create(_named(c), "ATLANTIS", "/sea", None, at)
    made = collections.update_path(collections.rename(made, "NATION_6", "HEXAGON", at), "NATION_16", "/moved", at, ["*.txt", "!x/**"])
    place = F.row_number().over(Window.orderBy("name")) - 1  # a small table of names
    return made.select("id", "name", "pwd", F.array_join("glob_patterns", " ").alias("patterns"), place.cast("long").alias("place"))


@query(
    "collection_removed",
    _INDEX
    + """, rest AS (SELECT * FROM docs WHERE source_collection_id <> 3) SELECT 'documents' AS name, count(*) AS n FROM rest UNION ALL SELECT 'content', count(*) FROM content WHERE hash IN (SELECT hash FROM rest) UNION ALL SELECT 'content_vectors', count(*) FROM vectors WHERE hash IN (SELECT hash FROM rest)
UNION ALL SELECT 'lengths', count(*) FROM fts WHERE id IN (SELECT id FROM rest) UNION ALL SELECT 'postings', count(*) FROM (SELECT DISTINCT id, col, term FROM pos) WHERE id IN (SELECT id FROM rest) UNION ALL SELECT 'document_metadata', count(*) FROM rest WHERE id % 3 <> 0 UNION ALL SELECT 'document_tags', count(*) FROM tags WHERE document_id IN (SELECT id FROM rest)""",
)
def _(c):
    """Rows of each table that a removed collection leaves."""
    own = c.documents.select("id", F.col("source_collection_id").alias("_c"))
    stored = _stored(c)
    stored["documents"] = stored["documents"].join(own, "id").withColumn("source_collection_id", F.col("_c")).drop("_c")
    left, out = upkeep.remove_collection(stored, 3).tables, None
    for name in ("documents", "content", "content_vectors", "lengths", "postings", "document_metadata", "document_tags"):
        line = left[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = line if out is None else out.union(line)
    return out


@query("upsert_repeated", "SELECT path, 'h2' AS hash FROM docs WHERE id % 9 = 0 UNION ALL SELECT path, hash FROM docs WHERE id % 9 <> 0 UNION ALL SELECT 'twice/' || id, 'h2' FROM docs WHERE id % 40 = 0")
def _(c):
    """A key that comes twice in one load is one document, as it was written last."""
    keys = c.documents.where(F.col("id") % 9 == 0).select("path").union(c.documents.where(F.col("id") % 40 == 0).select(F.concat(F.lit("twice/"), F.col("id").cast("string"))))
    at = lambda day, h: keys.select(F.lit(1).cast("long").alias("source_collection_id"), "path", F.col("path").alias("title"), F.lit(h).alias("hash"), F.lit(day).cast("timestamp_ntz").alias("modified_at"))
    new = at("2024-02-02", "h2").union(at("2024-02-01", "h1"))
    return store.upsert_documents(_stored(c)["documents"], new).select("path", "hash")


@query(
    "change_feed",
    _LISTING + """, after_ AS (SELECT d.path, coalesce(l.hash, d.hash) AS hash, d.active OR l.path IS NOT NULL AS active FROM docs d LEFT JOIN listing l USING (path) WHERE d.id % 10 <> 4 UNION ALL SELECT path, hash, true FROM listing WHERE path NOT IN (SELECT path FROM docs))
SELECT coalesce(a.path, d.path) AS path, coalesce(a.hash, d.hash) AS hash, coalesce(a.active, d.active) AS active, CASE WHEN d.path IS NULL THEN 'insert' WHEN a.path IS NULL THEN 'delete' ELSE 'update' END AS change FROM after_ a FULL JOIN docs d USING (path) WHERE a.hash IS DISTINCT FROM d.hash OR a.active IS DISTINCT FROM d.active""",
)
def _(c):
    """Two commits to a store, an upsert of a listing and a deletion, as the feed of what they changed;
    the twin compares the whole tables."""
    w = Warehouse(c.spark, temporary(c.spark, "feed"))
    stored = _stored(c)["documents"]
    first = w.commit({"documents": stored})
    listed = _listing(c).select(F.lit(1).cast("long").alias("source_collection_id"), "path", "hash")
    new = listed.withColumns({"title": F.col("path"), "modified_at": F.expr(_AT)}).join(stored.where("id % 10 = 4").select("path"), "path", "left_anti")
    told = store.upsert_documents(w.read("documents"), new).drop("is_new").join(new.select("path"), "path", "left_semi").select(*stored.columns)
    w.commit({"documents": upkeep.Change(store.KEYS, told)})
    w.commit({"documents": upkeep.Change(store.KEYS, gone=stored.where("id % 10 = 4").select(*store.KEYS))})
    return w.changes("documents", first).select("path", "hash", "active", "change")


@query("sql_parameters", "SELECT lang, count(*) AS n FROM docs WHERE id >= 10 AND lang <> 'en' GROUP BY 1")
def _(c):
    """The SQL surface: text with named parameters over a view."""
    return c.spark.sql("SELECT lang, count(*) AS n FROM {docs} WHERE id >= :least AND lang <> :other GROUP BY lang", args={"least": 10, "other": "en"}, docs=c.documents)


@query("ontology_children", _EDGES + " SELECT parent AS tag, child, coalesce(n, 0) AS n FROM edges LEFT JOIN " + _CARRIED.format(name="child") + " USING (child)")
def _(c):
    """The children of each tag of the ontology, and how many documents carry them."""
    known = tags.load_ontology()
    below = small(c.spark, [(t, x) for t in sorted(known.tags) for x in known.children(t)], "tag string, child string")
    return below.join(tags.frequency(c.tags).withColumnRenamed("tag", "child"), "child", "left").select("tag", "child", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
