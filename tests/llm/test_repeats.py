import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import repeats


def brute(rows):
    """The definition, byte string by byte string."""
    out = []
    starts: dict[bytes, int] = {}
    data = [((1 << 62) if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - repeats.LENGTH + 1):
            w = b[p : p + repeats.LENGTH]
            starts[w] = min(starts.get(w, i), i)
    for (i, _), (k, b) in zip(rows, data):
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - repeats.LENGTH + 1):
            if starts[b[p : p + repeats.LENGTH]] < k:
                gone[p : p + repeats.LENGTH] = True
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(small):
    want = brute([(r["doc_id"], r["text"]) for r in small.collect()])
    assert rows_of(repeats.op1(small)) == want


def test_edges(edge, empty):
    assert rows_of(repeats.op1(edge)) == brute([(r["doc_id"], r["text"]) for r in edge.collect()])
    assert repeats.op1(empty).count() == 0


def test_passages_at_any_offset(spark):
    rng = np.random.default_rng(3)
    passage = "".join(map(chr, rng.integers(97, 123, 70)))
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    rows = [(i, noise(int(rng.integers(0, 90))) + passage[int(rng.integers(0, 15)) : 55 + int(rng.integers(0, 16))] + noise(int(rng.integers(0, 90)))) for i in range(60)]
    rows += [(100 + i, "ab" * int(rng.integers(20, 60))) for i in range(6)]  # a period: many equal strings in one text
    assert rows_of(repeats.op1(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


@given(st.binary(min_size=50, max_size=300))
@settings(max_examples=60, deadline=None)
def test_every_stretch_has_an_anchor(data):
    at, _ = repeats.anchors(data)
    for p in range(len(data) - repeats.LENGTH + 1):
        assert ((at >= p) & (at + repeats.ANCHOR <= p + repeats.LENGTH)).any()


def test_without_repeats_keeps_columns(edge):
    got = repeats.without_repeats(edge)
    assert got.columns == edge.columns
    texts = {(r["doc_id"], r["text"]) for r in got.collect()}
    first = edge.where("doc_id = 1").first()["text"]
    assert (1, first) in texts and (2, first) not in texts
