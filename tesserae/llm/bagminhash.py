"""Near-duplicate detection on word-shingle multisets with BagMinHash signatures.

A text is the multiset of its ``SHINGLE``-word shingles; likeness is the weighted Jaccard
coefficient of the multiplicities. A signature component is the earliest point of a Poisson
process over time and weight: each shingle owns dyadic strips of discretised weights ([0,1),
[1,2), [2,4), ...), a strip's points arrive with a rate of its width, each falls on one component
and on one weight level, and counts where that level is below the shingle's multiplicity. Two
texts agree in a component with a probability of exactly their likeness. Points are made in order
of time until they pass the latest component, so a long text needs few points beyond its first.

``BANDS`` bands of ``ROWS`` components propose groups of texts; a pair of likeness 0.8 is missed
with a probability under 5e-5. Texts with equal multisets collapse first. Within a group, the
member that shares the most groups is compared with the others (a star, not all pairs); links are
joined to classes; after that, only members of different classes are compared: all such pairs in
small groups, and in large ones those that an exact prefix filter on the rarest shingles leaves.
Every candidate is verified on its exact multiset overlap. Comparisons with one leader are dealt over
many tasks, its multiset being sent to each.

Edge cases: words are runs of letters and digits, in lower case. A text of fewer words than a
shingle is one shingle; a text without words is the class of the texts with its characters; null
counts as empty. Rows with equal ids are kept apart by their texts. A class id is the least id of
the class. Other columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Interner, dealt, held, join_hot, parts_of, placed, plain, shuffle_partitions, staged
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
LARGE_GROUP = 48
MEMBERS_A_TASK = 1000
PART_BYTES = 32 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs give equal, unequal ones scattered outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1] from hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


class Shingler:
    """Shingle multisets of texts; one for each Python worker, with a bounded word table."""

    def __init__(self, shingle: int = SHINGLE) -> None:
        self.shingle = shingle
        self.words = Interner(200_000)
        self.hash = np.zeros(1 << 14, dtype=np.uint64)

    def bag(self, text: str) -> np.ndarray:
        """Sorted shingle hashes, repeated as often as they occur."""
        if self.words.full:
            self.words.reset()
        rows = np.fromiter(map(self.words.__getitem__, text.split()), dtype=np.int64)
        if fresh := self.words.take_fresh():
            need, first = len(self.words), len(self.words) - len(fresh)
            while len(self.hash) < need:
                self.hash = np.concatenate([self.hash, np.zeros_like(self.hash)])
            cores = [(w if w.isalnum() else "".join(filter(str.isalnum, w))).lower() for w in fresh]
            self.hash[first:need] = [xxhash.xxh64_intdigest(c.encode()) | 1 if c else 0 for c in cores]
        h = self.hash[rows]
        h = h[h != 0]
        n, k = len(h), self.shingle
        if not n:
            return np.array([xxhash.xxh64_intdigest(b"\x00" + text.encode())], dtype=np.uint64) if text else np.zeros(0, dtype=np.uint64)
        k = min(n, k)
        out = np.full(n - k + 1, np.uint64(k))
        for i in range(k):
            out = mix(out * _PRIME + h[i : n - k + 1 + i])
        out.sort()
        return out


def occurrences(bag: np.ndarray) -> np.ndarray:
    """The multiset as a sorted set: each repetition gets a value of its own, so that the
    Jaccard coefficient of two such sets is the weighted one of the multisets."""
    if not len(bag):
        return bag
    new = np.concatenate([[True], bag[1:] != bag[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(len(bag)), 0))
    out = mix(bag + (np.arange(len(bag)) - first).astype(np.uint64) * _PRIME)
    out.sort()
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard coefficient of two multisets given by their ``occurrences``."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(a) + len(b) - common)


def signatures(bags: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash signatures ``[n, size]`` of sorted multisets: times of the earliest points."""
    n = len(bags)
    sig = np.full(n * size, np.inf)
    heads = [np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, dtype=np.int64) for b in bags]
    owner = np.repeat(np.arange(n), [len(h) for h in heads])
    if not len(owner):
        return sig.reshape(n, size)
    value = np.concatenate([b[h] for b, h in zip(bags, heads)])
    weight = np.concatenate([np.diff(np.append(h, len(b))) for b, h in zip(bags, heads)])
    parts = [(owner, value, weight, 0, 1)]
    low = 1
    while (deep := weight > low).any():
        parts.append((owner[deep], value[deep], weight[deep], low, low))
        low *= 2
    own = np.concatenate([p[0] for p in parts])
    level = np.concatenate([np.full(len(p[0]), p[3]) for p in parts])
    width = np.concatenate([np.full(len(p[0]), p[4]) for p in parts]).astype(np.float64)
    top = np.concatenate([p[2] for p in parts])
    state = mix(np.concatenate([p[1] for p in parts]) + level.astype(np.uint64) * _PRIME)
    time = np.zeros(len(own))
    while len(own):
        state = mix(state + _PRIME)
        time = time - np.log(_unit(state)) / width
        more = mix(state ^ np.uint64(0xD6E8FEB86659FD93))
        part = ((more >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        counts = level + ((more & np.uint64(0xFFFFFFFF)).astype(np.float64) * (1.0 / (1 << 32)) * width).astype(np.int64) < top
        at = own * size + part
        np.minimum.at(sig, at[counts], time[counts])
        latest = sig.reshape(n, size).max(1)
        live = time < latest[own]
        own, level, width, top, state, time = own[live], level[live], width[live], top[live], state[live], time[live]
    return sig.reshape(n, size)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands))
    for i in range(rows):
        key = mix(key * _PRIME + bits[:, :, i])
    return key.view(np.int64)


def _shingler(shingle: int) -> Shingler:
    return held("bagminhash", shingle, lambda: Shingler(shingle))


def _digest(bag: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(bag)


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    mark = F.xxhash64(body)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(key).cast("long"), mark).alias("id"), mark.alias("mark"), body.alias("text"))


def sketch(docs: DataFrame, text: str = "text", key: str = "doc_id", *, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, id, mark, digest, bands`` of each row: the id (for a null one a hash of the text),
    a hash of the text, and a digest that equal multisets share. Map-only."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _shingler(shingle)

        def made(rows: list[tuple], bags: dict[bytes, np.ndarray]) -> pa.RecordBatch:
            place = {d: i for i, d in enumerate(bags)}
            keys = band_keys(signatures(list(bags.values())))
            empty = [not len(b) for b in bags.values()]
            bands = [None if empty[place[r[3]]] else keys[place[r[3]]] for r in rows]
            columns = [*zip(*rows), bands]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "id", "mark", "digest", "bands"])

        for batch in batches:
            rows: list[tuple] = []
            bags: dict[bytes, np.ndarray] = {}
            amount = 0
            for doc_id, own, mark, x in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                bag = words.bag(x.as_py())
                d = _digest(bag)
                if d not in bags:
                    bags[d] = bag
                    amount += len(bag)
                rows.append((doc_id, own, mark, d))
                if amount > 150_000:
                    yield made(rows, bags)
                    rows, bags, amount = [], {}, 0
            if rows:
                yield made(rows, bags)

    return _keyed(docs, text, key).mapInArrow(apply, "doc_id long, id long, mark long, digest binary, bands array<long>")


def _bags_of(docs: DataFrame, wanted: DataFrame, text: str, key: str, shingle: int) -> DataFrame:
    """``id, bag`` (packed occurrences) of the wanted ``(id, of, digest)``, where ``of`` is the
    document that has the multiset ``id``; a row of that document with another one is passed over."""
    joined = wanted.join(_keyed(docs, text, key).select(F.col("id").alias("of"), "text"), "of").select("id", "digest", "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _shingler(shingle)
        for batch in batches:
            ids, out = [], []
            for own, want, x in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                bag = words.bag(x.as_py())
                if _digest(bag) == want.as_py():
                    ids.append(own)
                    out.append(occurrences(bag).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "bag"])

    return joined.mapInArrow(apply, "id long, bag binary").dropDuplicates(["id"])


def verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` whose likeness reaches the threshold. Rows meet at ``a``, dealt over
    as many tasks as its partners fill; each gets a copy of ``a``'s multiset."""
    spark = pairs.sparkSession
    n = F.greatest(F.lit(1), F.ceil(F.col("n") / MEMBERS_A_TASK)).cast("int")
    size = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", n.alias("deals"))
    members = pairs.join(size, "a").select("a", F.pmod(F.xxhash64("b"), F.col("deals")).cast("int").alias("deal"), F.col("b").alias("id"), F.lit(1).alias("role"))
    leads = size.select("a", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.col("a").alias("id"), F.lit(0).alias("role"))
    dealt = members.union(leads).join(bags, "id").repartition(shuffle_partitions(spark), "a", "deal").sortWithinPartitions("a", "deal", "role")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lead = None, None
        for batch in batches:
            left, right = [], []
            columns = {name: i for i, name in enumerate(batch.schema.names)}
            a, deal, own, role = (batch.column(columns[c]).to_pylist() for c in ("a", "deal", "id", "role"))
            for i, bag in enumerate(batch.column(columns["bag"])):
                bag = np.frombuffer(bag.as_py(), dtype=np.uint64)
                if role[i] == 0:
                    at, lead = (a[i], deal[i]), bag
                elif at == (a[i], deal[i]) and min(len(bag), len(lead)) >= threshold * max(len(bag), len(lead)) and likeness(lead, bag) >= threshold:
                    left.append(a[i])
                    right.append(own[i])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return dealt.select("a", "deal", "id", "role", "bag").mapInArrow(apply, "a long, b long")


def _needed(n, m, threshold: float):
    """The least overlap of two sets of these sizes at the threshold."""
    return np.ceil((n + m) * (threshold / (1 + threshold)) - 1e-9)


def prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(a, b)`` of ``(id, label, bag)`` rows of different labels that can reach the
    threshold, by an exact prefix filter.

    A set's elements are ordered from the rarest. Two sets at the threshold share one of the
    first ``n - ceil(threshold * n) + 1`` of either, and what remains after the first shared one
    bounds their overlap. Elements that only one set holds come first and cost nothing. Elements
    travel packed, by their hash: once to be counted, once (prefixes only) to meet.
    """
    spark = sets.sparkSession
    owners = parts_of(sets, PART_BYTES)
    address = placed(owners, shuffle_partitions(spark)).tolist()
    number = {a: o for o, a in enumerate(address)}
    source = sets.select(dealt(F.pmod(F.xxhash64("id"), F.lit(owners)), owners, spark).alias("batch"), "id", "label", "bag").groupBy("batch")
    message = "to long, batch long, payload binary"
    kinds = (pa.int64(), pa.int64(), pa.binary())

    def table(rows: list[tuple]) -> pa.Table:
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 3, kinds)], names=["to", "batch", "payload"])

    def elements(batch: pa.Table):
        bags = [np.frombuffer(b.as_py(), dtype=np.uint64) for c in batch.column("bag").chunks for b in c]
        keys, place, counts = np.unique(np.concatenate(bags), return_inverse=True, return_counts=True)
        owner = (keys >> np.uint64(33)).astype(np.int64) % owners
        order = np.argsort(owner, kind="stable")
        return bags, keys, place, counts, order, np.searchsorted(owner[order], np.arange(owners + 1))

    def ask(batch: pa.Table) -> pa.Table:
        _, keys, _, counts, order, cuts = elements(batch)
        n = batch.column("batch")[0].as_py()
        return table([(address[o], n, keys[order[lo:hi]].tobytes() + counts[order[lo:hi]].astype(np.int64).tobytes()) for o, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if hi > lo])

    def count(batch: pa.Table) -> pa.Table:
        parts = [np.frombuffer(p.as_py(), dtype=np.uint64).reshape(2, -1) for c in batch.column("payload").chunks for p in c]
        keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.bincount(place, np.concatenate([p[1] for p in parts]).astype(np.float64)).astype(np.int64)
        out = np.split(total[place], np.cumsum([p.shape[1] for p in parts])[:-1])
        return table([(batch.column("to")[0].as_py(), b, x.tobytes()) for b, x in zip(batch.column("batch").to_pylist(), out)])

    def heads(batch: pa.Table, heard: pa.Table) -> pa.Table:
        if not batch.num_rows:
            return table([])
        bags, keys, place, _, order, cuts = elements(batch)
        many = np.zeros(len(keys), dtype=np.int64)
        for o, p in zip(map(number.__getitem__, heard.column("to").to_pylist()), heard.column("payload").to_pylist()):
            many[order[cuts[o] : cuts[o + 1]]] = np.frombuffer(p, dtype=np.int64)
        found, at = [], 0
        for own, label, bag in zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), bags):
            here = place[at : at + len(bag)]
            at += len(bag)
            n = len(bag)
            rank = np.lexsort((bag, many[here]))[: n - int(np.ceil(threshold * n - 1e-9)) + 1]
            spot = np.flatnonzero(many[here[rank]] > 1)
            found.append(np.stack([bag[rank[spot]].view(np.int64), *(np.full(len(spot), v) for v in (own, label, n)), spot]))
        all_ = np.concatenate(found, axis=1)
        owner = (all_[0].view(np.uint64) >> np.uint64(33)).astype(np.int64) % owners
        return table([(address[o], 0, np.ascontiguousarray(all_[:, owner == o]).tobytes()) for o in np.unique(owner)])

    def meet(batch: pa.Table) -> pa.Table:
        parts = [np.frombuffer(p.as_py(), dtype=np.int64).reshape(5, -1) for c in batch.column("payload").chunks for p in c]
        x = np.concatenate(parts, axis=1)
        x = x[:, np.lexsort((x[1], x[0]))]
        begin = np.flatnonzero(np.concatenate([[True], x[0, 1:] != x[0, :-1]]))
        pairs: set[tuple[int, int]] = set()
        for lo, hi in zip(begin, np.append(begin[1:], x.shape[1])):
            if hi - lo < 2 or (x[2, lo:hi] == x[2, lo]).all():
                continue
            _, own, label, n, spot = x[:, lo:hi]
            for i in range(len(own) - 1):
                j = np.arange(i + 1, len(own))
                fits = (label[j] != label[i]) & (np.minimum(n[i] - spot[i], n[j] - spot[j]) >= _needed(n[i], n[j], threshold))
                pairs.update((int(own[i]), int(b)) for b in own[j[fits]])
        out = sorted((min(p), max(p)) for p in pairs if p[0] != p[1])
        return pa.table([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    counted = source.applyInArrow(ask, message).groupBy("to").applyInArrow(count, message)
    return source.cogroup(counted.groupBy("batch")).applyInArrow(heads, message).groupBy("to").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", *, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id`` of every row, its ``id`` and text hash ``mark``, and whether it is the
    one of its class to ``keep``."""
    rows = staged(sketch(docs, text, key, shingle=shingle), "sketch")
    texts = rows.groupBy("digest").agg(F.min("id").alias("of"), F.first("bands").alias("bands"))
    texts = staged(texts.withColumn("id", F.xxhash64("digest")), "texts")  # what is linked are distinct multisets
    spread = texts.where(F.col("bands").isNotNull()).select("id", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    members = staged(join_hot(spread, shared, "band"), "members")
    rank = members.groupBy("id").agg(F.sum("size").alias("rank"))
    members = staged(members.join(rank, "id"), "members")
    wanted = rank.select("id").join(texts.select("id", "of", "digest"), "id")
    bags = staged(_bags_of(docs, wanted, text, key, shingle), "bags")
    first = F.struct(F.col("rank"), -F.col("id"))

    lead = members.groupBy("band").agg((-F.max(first)["col2"]).alias("a"))
    star = join_hot(members, lead, "band").where(F.col("a") != F.col("id")).select("a", F.col("id").alias("b")).distinct()
    links = staged(verified(star, bags, threshold), "links")
    labels = components(links)

    def classed() -> DataFrame:
        """Members of the groups that still hold several classes."""
        now = members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        mixed = now.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where(F.col("lo") != F.col("hi")).select("band")
        return staged(now.join(mixed, "band"), "mixed")  # semi-joins of groups that are left

    left = classed()
    small = left.where(F.col("size") <= LARGE_GROUP).select("band", "id", "label")
    other = small.select("band", F.col("id").alias("b"), F.col("label").alias("of"))
    near = small.join(other, "band").where((F.col("id") < F.col("b")) & (F.col("label") != F.col("of"))).select(F.col("id").alias("a"), "b")
    large = left.where(F.col("size") > LARGE_GROUP).select("id", "label").distinct()
    rest = near.union(prefix_pairs(large.join(bags, "id"), threshold)).distinct()
    more = staged(verified(rest, bags, threshold), "links")
    if more.limit(1).count():
        labels = components(links.union(more))
    of = staged(texts.select("digest", "id").join(labels, "id", "left").select("digest", F.coalesce("label", "id").alias("label")), "classes")
    rows = rows.select("doc_id", "id", "mark", "digest")
    # a class may hold a third of the multisets, and a multiset a third of the rows: the first row
    # of each is found with partial minima, and told by joins that deal such keys over many tasks
    own = rows.groupBy("digest").agg(F.min(F.struct("id", "mark")).alias("own"))
    held_ = staged(of.join(own, "digest"), "classes")
    first = held_.groupBy("label").agg(F.min("own").alias("first"))
    told = staged(join_hot(held_, first, "label").select("digest", "first"), "firsts")
    rows = join_hot(rows, told, "digest")
    return rows.select("doc_id", F.col("first.id").alias("class_id"), "id", "mark", (F.struct("id", "mark") == F.col("first")).alias("keep"))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The documents, all columns kept, of which one of each near-duplicate class stays: the one
    of the least id (among rows of one id the least text hash; of equal rows any one)."""
    kept = near_duplicates(docs, text, key, **options).where("keep").select(F.col("id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    rows = plain(docs)
    body, own = (rows[rows.columns[docs.columns.index(c)]] for c in (text, key))
    mark = F.xxhash64(F.coalesce(body, F.lit("")))
    marked = rows.select("*", F.coalesce(own.cast("long"), mark).alias("_id"), mark.alias("_mark"))
    return marked.join(kept, ["_id", "_mark"], "left_semi").dropDuplicates(["_id", "_mark"]).select(*rows.columns).toDF(*docs.columns)


def op7(docs: DataFrame) -> DataFrame:
    """One row a document with its class id."""
    return near_duplicates(docs).select("doc_id", "class_id")
