import threading
import uuid

import pytest

from tesserae.llm import compaction


@pytest.fixture
def store(spark, tmp_path):
    return compaction.ShardStore(spark, str(tmp_path / uuid.uuid4().hex))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_rows_survive(store, edge, small):
    store.append(edge)
    assert rows(store.read()) == rows(edge)
    both = edge.union(edge)
    store.append(edge, shard_rows=2)
    before = len(store.manifest()["shards"])
    version = store.compact()
    assert len(store.manifest()["shards"]) < before and rows(store.read(version)) == rows(both)
    assert rows(store.read(1)) == rows(edge)  # an older version still reads as it was
    assert store.vacuum() == 0  # the files are young
    assert store.vacuum(least_age=0.0) > 0 and store.versions() == [version] and rows(store.read()) == rows(both)


def test_runs_reach_the_target(store, small):
    store.append(small.repartition(8), shard_rows=10)
    target = sum(s for _, s in store.manifest()["shards"]) // 3
    store.compact(target)
    sizes = [s for _, s in store.manifest()["shards"]]
    assert 2 <= len(sizes) <= 8 and rows(store.read()) == rows(small)
    assert store.compact(1) == store.manifest()["version"]  # nothing is small against this target


def test_plan_keeps_tiers_together():
    shards = [compaction.Shard(f"s{i}", n) for i, n in enumerate([100_000] * 6 + [4_000_000] * 3 + [60_000_000])]
    runs = compaction.ShardStore.plan(None, shards, 8_000_000)
    assert all(sum(s.size for s in r) <= 8_000_000 for r in runs)
    assert "s9" not in {s.name for r in runs for s in r}


def test_commits_are_atomic(store, small):
    base = store.manifest()
    store.append(small)
    with pytest.raises(compaction.CommitConflict):
        store.commit(base, [], "{}")
    assert store.versions() == [1] and rows(store.read()) == rows(small)


def test_writers_at_once(spark, store, small):
    """Of writers that start from one version one wins, and no reader sees a part of a commit."""
    store.append(small.limit(10))
    base, told = store.manifest(), []

    def write(n):
        try:
            told.append(compaction.ShardStore(spark, store.root).commit(base, [compaction.Shard(f"w{n}", 1)], base["schema"]))
        except compaction.CommitConflict:
            told.append(None)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(told, key=str) == [2] + [None] * 5 and len(store.manifest()["shards"]) == 1


def test_a_dead_writer(store, small, tmp_path):
    store.append(small)
    (tmp_path / store.root.rsplit("/", 1)[1] / "manifest/000000000002.json").write_text('{"vers')
    assert store.manifest()["version"] == 1 and rows(store.read()) == rows(small)
    with pytest.raises(compaction.CommitConflict):
        store.append(small)
    store.vacuum(least_age=0.0)
    assert store.append(small) == 2 and store.read().count() == 2 * small.count()


def test_empty(store, empty):
    store.append(empty)
    assert store.read().count() == 0 and compaction.op8(empty).count() == 0


def test_a_run_holds_one_tier_and_a_tier_waits_for_its_fanout():
    plan = lambda sizes, **k: [[s.size for s in r] for r in compaction.ShardStore.plan(None, [compaction.Shard(f"s{i}", n) for i, n in enumerate(sizes)], 64 << 20, **k)]
    small, large = [100_000] * 4, [20_000_000] * 3
    assert plan(small + large) == [small]
    assert plan(small[:3] + large) == []
    assert plan(small[:3] + large, least=2) == [small[:3], large]
