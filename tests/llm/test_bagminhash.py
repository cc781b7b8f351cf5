import numpy as np
import pytest

from tesserae.llm import bagminhash as bmh
from tesserae.llm.components import components


def brute(rows, threshold=bmh.THRESHOLD):
    """Classes by comparing all pairs of distinct multisets."""
    shingler = bmh.Shingler()
    bags: dict[bytes, tuple] = {}
    of = []
    for i, t in rows:
        bag = shingler.bag(t or "")
        of.append(bmh._digest(bag))
        least = min(i, bags[of[-1]][0]) if of[-1] in bags else i
        bags[of[-1]] = (least, bmh.occurrences(bag))
    parent = {d: d for d in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(bags)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if len(bags[a][1]) and len(bags[b][1]) and bmh.likeness(bags[a][1], bags[b][1]) >= threshold:
                parent[find(a)] = find(b)
    least: dict[bytes, int] = {}
    for d in keys:
        least[find(d)] = min(least.get(find(d), bags[d][0]), bags[d][0])
    return sorted((i, least[find(d)]) for (i, _), d in zip(rows, of))


def test_whole_table(small):
    want = brute([(r["doc_id"], r["text"]) for r in small.collect()])
    assert sorted((r["doc_id"], r["class_id"]) for r in bmh.op7(small).collect()) == want


@pytest.mark.parametrize("large", [3, 48])
def test_a_group_whose_members_are_not_all_alike(spark, large, monkeypatch):
    monkeypatch.setattr(bmh, "LARGE_GROUP", large)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for p in rng.integers(0, 120, int(rng.integers(0, 7))):
            words[p] = f"new{rng.integers(1 << 30)}"
        rows.append((i, " ".join(words)))
    got = sorted((r["doc_id"], r["class_id"]) for r in bmh.op7(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_edges(edge, empty):
    rows = bmh.near_duplicates(edge).collect()
    assert len(rows) == edge.count() and bmh.op7(empty).count() == 0
    kept = bmh.one_of_each(edge)
    assert kept.columns == edge.columns
    texts = [r["text"] or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == 8


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.8):
        a = np.sort(rng.integers(0, 40, 300).astype(np.uint64) * np.uint64(7919))
        b = np.sort(np.where(rng.random(300) < share, a, rng.integers(0, 40, 300).astype(np.uint64) * np.uint64(104729)))
        j = bmh.likeness(bmh.occurrences(a), bmh.occurrences(b))
        s = bmh.signatures([a, b], 3000)
        assert abs((s[0] == s[1]).mean() - j) < 5 * np.sqrt(j * (1 - j) / 3000) + 1e-9


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r["id"]: r["label"] for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[100] == got[101] == got[102] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
