import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tesserae.llm import bloomlm


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held(i), len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(x))) for i, x in rows), key=str)
    got = sorted((tuple(r) for r in bloomlm.op2(df).collect()), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])
    assert all(math.isfinite(g[6]) and g[6] <= 0 for g in got)
    return got


def test_base_is_exact_and_the_model_is_better(small):
    got = [g for g in check(small) if g[1]]
    assert sum(g[6] for g in got) > sum(g[5] for g in got)


def test_edges(edge, empty):
    check(edge)
    assert bloomlm.op2(empty).count() == 0


def test_filter_reads_levels_back():
    grams = np.random.default_rng(0).integers(0, 1 << 63, 20_000).astype(np.uint64)
    counts = np.random.default_rng(1).integers(1, 500, 20_000)
    f = bloomlm.CountFilter([bloomlm.fill(grams, counts, 1 << 22)], 1 << 22)
    got, want = f.level(grams), bloomlm.levels(counts)
    assert (got >= want).all() and (got == want).mean() > 0.97
    other = f.level(np.random.default_rng(2).integers(0, 1 << 63, 20_000).astype(np.uint64))
    assert (other > 0).mean() < 0.03


def test_a_slice_that_is_too_small_is_an_error():
    grams, counts = np.arange(10_000, dtype=np.uint64) * np.uint64(7919), np.arange(10_000) % 50 + 1
    with pytest.raises(ValueError):
        bloomlm.fill(grams, counts, 1 << 14)
    assert len(bloomlm.fill(grams, counts, bloomlm.capacity(counts))) * 8 == bloomlm.capacity(counts)


def test_score_by_brute_force(small):
    """The model from dictionaries of whole words and pairs with quantised counts: the filter differs by
    its few false positives alone, which only raise counts."""
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    train = [tokens(x) for i, x in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    one, two = Counter(t for ts in train for t in ts), Counter(p for ts in train for p in zip([None, *ts], ts))
    read = lambda n: float(bloomlm.read_count(bloomlm.levels(np.array([n])))[0]) if n else 0.0
    total = sum(one.values()) + len(one) + 1

    def p(v, w):
        seen = read(two[v, w])
        return math.log10((seen + bloomlm.PRIOR * (read(one[w]) + 1) / total) / (max(read(one[v]), seen) + bloomlm.PRIOR))

    want = {i: sum(p(v, w) for v, w in zip([None, *tokens(x)], tokens(x))) for i, x in rows}
    got = {r["doc_id"]: r["score"] for r in bloomlm.op2(small).collect()}
    gaps = np.array([abs(got[i] - want[i]) / -want[i] for i in want])
    assert np.median(gaps) < 0.005 and gaps.max() < 0.08 and abs(sum(got.values()) / sum(want.values()) - 1) < 0.01


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 10**7])
def test_read_count_is_near(n):
    got = bloomlm.read_count(bloomlm.levels(np.array([n])))[0]
    assert abs(got - n) <= 0.25 * n


def test_packing_of_keys():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64))
    k, c = bloomlm._unpack(bloomlm._pack(0, 0, keys, np.arange(len(keys)))[2])
    assert (k == keys).all() and (c == np.arange(len(keys))).all()


def test_the_filter_grows_with_what_is_counted():
    many = np.full(500_000, 10**15)
    assert bloomlm.capacity(many) > 8 * (48 << 20)  # past what any fixed 48 MiB takes
    for n in (0, 1, 3000, 200_000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, 2 * n).astype(np.uint64))
        counts = np.where(np.arange(len(keys)) % 2, np.arange(len(keys)) % 300 + 1, 0)
        level = bloomlm.read_back(keys, counts)
        assert (level >= np.where(counts > 0, bloomlm.levels(counts), 0)).all()
        assert n < 3000 or (level[counts == 0] > 0).mean() < 0.03


def test_every_ngram_of_the_training_texts_is_seen(spark):
    rows = [(i, f"a{i} b{i} c{i}") for i in range(3000)]
    got = {r["doc_id"]: r["score"] for r in bloomlm.op2(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 7 == 2]
    assert min(s for i, s in got.items() if i not in set(held)) > np.quantile([got[i] for i in held], 0.9) + 5
