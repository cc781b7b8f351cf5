"""Language-model scoring with a log-frequency Bloom filter.

The filter holds quantised counts of the training n-grams: an n-gram whose count lies in level j
(levels are powers of ``BASE``) is inserted once for each level 1..j, and its count is read back by
probing level after level until one is absent. It lies in slices by n-gram hash, each with an
owner. A batch of texts sends its distinct n-grams with their training counts to the owners; an
owner sums them, sizes its slice for all that it counted (``BITS_AN_ENTRY`` for each entry), fills
it, and answers each batch with the levels that its slice gives. So the filter grows with the
corpus, holds every n-gram of it, and no slice leaves its owner.

Scores are sums of ``log10((c(v, w) + PRIOR * p1(w)) / (c(v) + PRIOR))`` with the filter's counts,
where ``p1`` is the add-one unigram probability and ``v`` the token before (a text's end at its
start): the more often a token was seen, the more its followers weigh. The base score beside it uses exact counts of all tokens, which the owners' answers hold
too, so no vocabulary is ever broadcast.

Edge cases: a null text is its end token alone; an empty training set has N = V = 0 and base
score 0; long texts are ordinary rows; repeated rows are scored each; other columns are ignored.
Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Interner, dealt, doc_crc, held, parts_of, placed, shuffle_partitions

BASE = 1.4
#: Occurrences of a token before the next that weigh as much as the unigram probability.
PRIOR = 300.0
BITS_AN_ENTRY = 10
PROBES = 5
BLOCK = 512
BLOCK_TOKENS = 400_000
LEVELS = 96
PART_BYTES = 32 << 20  # of stored input for each batch and each owner
_P, _Q, _R = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
END = np.uint64(xxhash.xxh64_intdigest(b""))
MESSAGE = "to long, batch long, payload binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tag(level: int) -> np.uint64:
    return np.uint64(level * int(_R) & 0xFFFFFFFFFFFFFFFF)


def pairs(tokens: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Hashes of each token with the one before it, the end token standing before the first."""
    if before is None:
        before = np.concatenate([[END], tokens[:-1]])
    return _mix(before * _P + _mix(tokens + _Q))


def levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9), LEVELS).astype(np.int64)


def read_count(level: np.ndarray) -> np.ndarray:
    """The middle of a level's counts; 0 for level 0."""
    low = BASE ** (level - 1.0)
    return np.where(level > 0, np.maximum((np.ceil(low) + np.maximum(np.ceil(low * BASE) - 1, np.ceil(low))) / 2, 1.0), 0.0)


class CountFilter:
    """A log-frequency Bloom filter in equal slices. The probes of an entry fall into
    one block of ``BLOCK`` bits, so a membership test costs one trip to memory."""

    def __init__(self, slices: list[bytes], slice_bits: int) -> None:
        self.bits = np.frombuffer(b"".join(slices), dtype=np.uint8)
        self.owners, self.slice_bits = len(slices), slice_bits

    def level(self, grams: np.ndarray) -> np.ndarray:
        """The highest level up to which all are present, found by probing one after another."""
        out = np.zeros(len(grams), dtype=np.int64)
        live = np.arange(len(grams))
        base = owner_of(grams, self.owners) * self.slice_bits
        for j in range(1, LEVELS + 1):
            block, bits = _block(grams, j, self.slice_bits)
            block += base
            for i in range(PROBES):
                spot = block + _bit(bits, i)
                hit = (self.bits[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1 > 0
                if not hit.all():
                    live, grams, base, block, bits = live[hit], grams[hit], base[hit], block[hit], bits[hit]
                if not len(live):
                    return out
            out[live] = j
        return out


def fill(grams: np.ndarray, counts: np.ndarray, slice_bits: int) -> bytes:
    """A slice with all the n-grams; one that is too small for them is an error."""
    level = levels(counts)
    if int(level.sum()) * BITS_AN_ENTRY > slice_bits:
        raise ValueError(f"a slice of {slice_bits} bits can't take {int(level.sum())} entries")
    slots = np.zeros(slice_bits, dtype=np.uint8)
    j = 1
    while len(grams):
        block, bits = _block(grams, j, slice_bits)
        for i in range(PROBES):
            slots[block + _bit(bits, i)] = 1
        j += 1
        grams, level = grams[level >= j], level[level >= j]
    return np.packbits(slots).tobytes()


def capacity(counts: np.ndarray) -> int:
    """The bits of a slice that takes n-grams of these counts, every one of them."""
    return max(1, -(-int(levels(counts).sum()) * BITS_AN_ENTRY // BLOCK)) * BLOCK


def read_back(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The levels that a slice filled with all keys counted gives for all keys; a key of count 0 is
    asked for without having been counted."""
    taught = counts > 0
    slice_bits = capacity(counts[taught])
    return CountFilter([fill(keys[taught], counts[taught], slice_bits)], slice_bits).level(keys)


def _block(grams: np.ndarray, level: int, slice_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the block of each entry begins, and the hash that its bits in the block come from."""
    state = _mix(grams + _tag(level))
    block = (state >> np.uint64(32)) * np.uint64(slice_bits // BLOCK) >> np.uint64(32)
    return block.astype(np.int64) * BLOCK, state * _Q


def _bit(bits: np.ndarray, i: int) -> np.ndarray:
    return (bits >> np.uint64(64 - 9 * (i + 1)) & np.uint64(BLOCK - 1)).astype(np.int64)


class Words:
    """Tokens of texts as numbers of a word table with their hashes; one for each Python worker.
    Numbers hold until the next ``begin``, which empties a table that has grown past its bound."""

    def __init__(self) -> None:
        self.words = Interner(200_000)
        self.hash = np.zeros(1 << 14, dtype=np.uint64)
        self.begin()

    def begin(self) -> None:
        if self.words.full:
            self.words.reset()
        self.end = self.words[b""]  # no word is empty, so this is the end token

    def numbers(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        words.append(b"")
        return np.fromiter(map(self.words.__getitem__, words), dtype=np.int32, count=len(words))

    def hashes(self) -> np.ndarray:
        """The hashes of all words of the table."""
        need = len(self.words)
        if fresh := self.words.take_fresh():
            while len(self.hash) < need:
                self.hash = np.concatenate([self.hash, np.zeros_like(self.hash)])
            self.hash[need - len(fresh) : need] = [xxhash.xxh64_intdigest(w) for w in fresh]
        return self.hash[:need]


def _words() -> Words:
    return held("bloomlm", 0, Words)


def owner_of(keys: np.ndarray, owners: int) -> np.ndarray:
    """Owners hold equal ranges of hashes."""
    return ((keys >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def _pack(to: int, batch: int, keys: np.ndarray, counts: np.ndarray) -> tuple[int, int, bytes]:
    """Ascending keys as differences, byte plane by byte plane: the high planes are mostly zeros,
    which the shuffle's compression takes out."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return to, batch, np.int64(len(keys)).tobytes() + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes() + counts.astype(np.uint32).tobytes()


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(payload, dtype=np.int64, count=1)[0])
    steps = np.ascontiguousarray(np.frombuffer(payload, dtype=np.uint8, count=8 * n, offset=8).reshape(8, n).T).view(np.uint64).reshape(-1)
    return np.cumsum(steps, dtype=np.uint64), np.frombuffer(payload, dtype=np.uint32, count=n, offset=8 + 8 * n).astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their summed counts."""
    if not len(keys):
        return keys, np.zeros(0, dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begin], np.add.reduceat(counts[order], begin)


def _table(rows: list[tuple], names: tuple[str, ...], kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", train: str = "train") -> DataFrame:
    """Scores of all texts by the model of those that ``train`` marks."""
    spark = docs.sparkSession
    owners = parts_of(docs, PART_BYTES)
    address = placed(owners, shuffle_partitions(spark)).tolist()
    number = {a: o for o, a in enumerate(address)}
    which = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text)), F.lit(owners))
    source = docs.select(dealt(which, owners, spark).alias("_batch"), F.col(key).cast("long").alias("doc_id"), F.col(train).alias("train"), F.col(text).alias("text")).groupBy("_batch")

    def vocabulary(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The batch's tokens as places among its distinct ones, the keys of these in ascending
        order, their training counts, the keys of each token with the one before it, whether each
        token is of a training text, and the number of tokens of each text."""
        words = _words()
        words.begin()
        texts = [words.numbers(x.as_py()) for c in table.column("text").chunks for x in c]
        size = np.array([len(t) for t in texts])
        flat = np.concatenate(texts)
        del texts
        hashes = words.hashes()
        used = np.flatnonzero(np.bincount(flat, minlength=len(hashes)))
        used = used[np.argsort(hashes[used] & ~np.uint64(1), kind="stable")]
        place_of = np.zeros(len(hashes), dtype=np.int32)
        place_of[used] = np.arange(len(used))
        place = place_of[flat]
        taught = np.repeat(np.array(table.column("train").to_pylist(), dtype=bool), size)
        hashes = hashes[used]
        both = np.empty(len(place), dtype=np.uint64)
        for lo in range(0, len(place), BLOCK_TOKENS):  # blocks bound the memory; a text's end stands before the next text
            hi = min(lo + BLOCK_TOKENS, len(place))
            both[lo:hi] = pairs(hashes[place[lo:hi]], hashes[place[np.arange(lo - 1, hi - 1)]]) | np.uint64(1)
        return place, hashes & ~np.uint64(1), np.bincount(place[taught], minlength=len(used)), both, taught, size

    def ask(table: pa.Table) -> pa.Table:
        _, keys, counts, both, taught, _ = vocabulary(table)
        n = table.column("_batch")[0].as_py()
        both ^= (~taught).astype(np.uint64)  # the lowest bit tells training pairs while they are sorted
        both.sort()
        begin = np.flatnonzero(np.concatenate([[True], both[1:] >> np.uint64(1) != both[:-1] >> np.uint64(1)]))
        counts = np.concatenate([counts, np.add.reduceat((both & np.uint64(1)).astype(np.int64), begin)])
        keys = np.concatenate([keys, both[begin] | np.uint64(1)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        cuts = np.searchsorted(owner_of(keys, owners), np.arange(owners + 1))
        rows = [_pack(address[o], n, keys[a:b], counts[a:b]) for o, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]  # to all owners: each tells its part of the totals
        return pa.Table.from_batches([_table(rows, ("to", "batch", "payload"), (pa.int64(), pa.int64(), pa.binary()))])

    def reply(table: pa.Table) -> pa.Table:
        """For each batch: this owner's training tokens and distinct ones, the exact counts of the
        batch's words, and the levels of its n-grams."""
        payloads = [p for c in table.column("payload").chunks for p in c]
        parts = [_unpack(p.as_py()) for p in payloads]
        keys, counts = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        del parts
        level = read_back(keys, counts)
        level = level.astype(np.uint8)
        single = (keys & np.uint64(1)) == 0
        head = np.array([counts[single].sum(), (counts[single] > 0).sum()], dtype=np.int64).tobytes()
        owner = table.column("to")[0].as_py()
        rows = []
        for b, p in zip(table.column("batch").to_pylist(), payloads):
            asked = _unpack(p.as_py())[0]
            at = np.searchsorted(keys, asked)
            rows.append((owner, b, head + counts[at[(asked & np.uint64(1)) == 0]].tobytes() + level[at].tobytes()))
        return pa.Table.from_batches([_table(rows, ("to", "batch", "payload"), (pa.int64(), pa.int64(), pa.binary()))])

    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())

    def end(table: pa.Table, heard: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_batches([_table([], names, kinds)])
        place, keys, _, both, _, size = vocabulary(table)
        pair_keys = np.sort(both)
        pair_keys = pair_keys[np.concatenate([[True], pair_keys[1:] != pair_keys[:-1]])]
        exact, about, level = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.uint8), np.zeros(len(pair_keys), dtype=np.uint8)
        one, two = (np.searchsorted(owner_of(k, owners), np.arange(owners + 1)) for k in (keys, pair_keys))
        tokens = distinct = 0
        for o, p in zip(map(number.__getitem__, heard.column("to").to_pylist()), heard.column("payload")):
            p = p.as_py()
            here, n = keys[one[o] : one[o + 1]], int(one[o + 1] - one[o])
            more = np.frombuffer(p, dtype=np.int64, count=2)
            tokens, distinct = tokens + int(more[0]), distinct + int(more[1])
            exact[one[o] : one[o + 1]] = np.frombuffer(p, dtype=np.int64, count=n, offset=16)
            got = np.frombuffer(p, dtype=np.uint8, offset=16 + 8 * n)
            word = np.searchsorted(pair_keys[two[o] : two[o + 1]], here) + np.arange(n)  # both kinds of keys came in one order
            about[one[o] : one[o + 1]] = got[word]
            rest = np.ones(len(got), dtype=bool)
            rest[word] = False
            level[two[o] : two[o + 1]] = got[rest]
        total = tokens + distinct + 1
        base = np.log10((exact + 1) / total)
        read = read_count(np.arange(LEVELS + 1))
        about = read[about]
        single = (about + 1) / total
        known, sums = (exact > 0).astype(np.int64), ([], [], [])
        ends = np.cumsum(size)
        lo = 0
        while lo < len(size):  # blocks of whole texts bound the memory of what follows
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + BLOCK_TOKENS, side="right")))
            at, to = ends[lo] - size[lo], ends[hi - 1]
            here, before = place[at:to], place[np.arange(at - 1, to - 1)]
            begin = ends[lo:hi] - size[lo:hi] - at
            seen = read[level[np.searchsorted(pair_keys, both[at:to])]]
            p = np.log10((seen + PRIOR * single[here]) / (np.maximum(about[before], seen) + PRIOR))
            for total_, x in zip(sums, (known[here], base[here], p)):
                total_.extend(np.add.reduceat(x, begin).tolist())
            lo = hi
        taught = table.column("train").to_pylist()
        out = [(d, not t, n, k, tokens, b, q) for d, t, n, k, b, q in zip(table.column("doc_id").to_pylist(), taught, size.tolist(), *sums)]
        return pa.Table.from_batches([_table(out, names, kinds)])

    answers = source.applyInArrow(ask, MESSAGE).groupBy("to").applyInArrow(reply, MESSAGE)
    return source.cogroup(answers.groupBy("batch")).applyInArrow(end, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2(docs: DataFrame) -> DataFrame:
    """The contract's rows: learned from all documents but the held-out seventh, scored on all."""
    return score(docs.select("doc_id", "text", ((doc_crc() % 7) != 2).alias("train")))
