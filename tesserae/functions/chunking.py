"""Greedy chunking of texts by lines under a byte limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 6144
SLICE = 1 << 22  # characters of chunks that a task holds at a time, beside one text's


def split_text(text: str, max_bytes: int = MAX_BYTES) -> list[tuple[str, int]]:
    """``(chunk, byte offset)`` pairs. A text within the limit is one chunk as it is; else lines
    are packed while they fit, and a line over the limit is a chunk of its own."""
    if not text.strip():
        return []
    if len(text.encode()) <= max_bytes:
        return [(text, 0)]
    out: list[tuple[str, int]] = []
    held: list[str] = []
    size = start = 0
    for line in text.split("\n"):
        piece = line + "\n"
        n = len(piece.encode())
        if held and size + n > max_bytes:
            out.append(("".join(held).rstrip(), start))
            start, size, held = start + size, 0, []
        held.append(piece)
        size += n
    last = "".join(held).rstrip()
    return [*out, (last, start)] if last.strip() else out


def slices(batch: pa.RecordBatch, max_bytes: int) -> Iterator[list[tuple]]:
    """The chunks ``(id, seq, pos, text)`` of a batch ``(id, text)``, about ``SLICE`` characters at a time."""
    rows, held = [], 0
    for i, x in zip(batch.column(0), batch.column(1)):
        for n, (part, pos) in enumerate(split_text(x.as_py() or "", max_bytes)):
            rows.append((i.as_py(), n, pos, part))
            held += len(part)
        if held >= SLICE:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def chunk(docs: DataFrame, text: str = "text", key: str = "id", max_bytes: int = MAX_BYTES) -> DataFrame:
    """``(id, seq, pos, text)``: a linear fold per document, in Arrow batches; ``id`` has the type
    of the key. ``pos`` is the chunk's first byte."""
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = source.schema["id"].dataType

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, max_bytes):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.string()))], names=["id", "seq", "pos", "text"])

    return source.mapInArrow(apply, f"id {kind.simpleString()}, seq int, pos long, text string")
