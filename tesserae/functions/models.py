"""Model slots with deterministic offline defaults: embedding, query expansion and judging.

Each is a plain Python callable over a batch of texts, run in Arrow batches; a service client of
the same shape can take its place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import chunking

_WORD = re.compile(r"\w+")


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors of signed word counts in hashed places; equal texts get equal vectors."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, text in enumerate(texts):
            for w in _WORD.findall((text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % dim] += 1.0 if h >> 63 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return embed


def embed(text: Column, model: Callable[[list[str]], np.ndarray] | None = None) -> Column:
    """``array<float>`` of each text."""
    run = model or hashing_embedder()

    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series(list(run(texts.fillna("").tolist())))

    return F.pandas_udf(apply, "array<float>")(text)


def embed_chunks(docs: DataFrame, text: str, key: str, max_bytes: int, model: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """``(id, seq, pos, embedding)`` of the chunks of texts that are not blank: cut and embedded by one
    function, a slice of chunks at a time, so that no chunk leaves the task."""
    run = model or hashing_embedder()
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.int32(), pa.int64(), pa.list_(pa.float32())
        for batch in batches:
            for rows in chunking.slices(batch, max_bytes):
                rows = [r for r in rows if r[3].strip(" ")]
                if rows:
                    ids, seqs, starts, texts = zip(*rows)
                    vectors = [np.asarray(v, dtype=np.float32) for v in run(list(texts))]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *map(pa.array, (seqs, starts, vectors), kinds)], names=["id", "seq", "pos", "embedding"])

    return source.mapInArrow(apply, f"id {source.schema['id'].dataType.simpleString()}, seq int, pos long, embedding array<float>")


def lexical_judge(query: str, body: str, least: float = 0.5) -> bool:
    """Whether a text's first 1000 characters hold at least a share of the query's words."""
    asked, held = set(_WORD.findall(query.lower())), set(_WORD.findall(body[:1000].lower()))
    return bool(asked) and len(asked & held) >= least * len(asked)


def judge(candidates: DataFrame, model: Callable[[str, str], bool] = lexical_judge) -> DataFrame:
    """``(query_id, filepath, relevant, confidence, rerank_score, raw_token)`` of candidates
    ``(query_id, filepath, query, body)``; a judge that fails leaves a document neutral."""

    def apply(query: pd.Series, body: pd.Series) -> pd.DataFrame:
        rows = []
        for q, b in zip(query, body):
            try:
                yes = bool(model(q or "", b or ""))
                rows.append((yes, 0.9 if yes else 0.1, 0.95 if yes else 0.45, "yes" if yes else "no"))
            except Exception:
                rows.append((False, 0.0, 0.5, "error"))
        return pd.DataFrame(rows, columns=["relevant", "confidence", "rerank_score", "raw_token"])

    verdict = F.pandas_udf(apply, "relevant boolean, confidence double, rerank_score double, raw_token string")
    return candidates.select("query_id", "filepath", verdict("query", "body").alias("v")).select("query_id", "filepath", "v.*")


def expand(query: str, reply: Callable[[str], str] | None = None, most: int = 2) -> list[str]:
    """The query and up to ``most`` variations of a model's reply; a failure leaves the query."""
    try:
        lines = [x.strip() for x in (reply(query) if reply else "").split("\n")]
    except Exception:
        lines = []
    clean = [re.sub(r"[.?!:]$", "", re.sub(r"^(\d\.\s?|[-*•]\s*)", "", x)).strip() for x in lines]
    return [query, *[x for x in clean if x][:most]]
