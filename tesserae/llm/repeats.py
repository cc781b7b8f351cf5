"""Exact removal of long strings that an earlier document holds already.

Each text is its UTF-8 bytes. A byte goes if it lies in a string of ``LENGTH`` bytes that also
starts in a document of a smaller id; all is judged on the input.

Whatever two documents share over ``LENGTH`` bytes holds an *anchor*, a 16-byte string whose hash
is least among the 35 in that stretch, chosen alike in both. So the work is dealt by anchor hash:

1. Texts are dealt into batches by a hash. Each batch sends its anchors' hashes, packed, to the
   task that owns the hash, which answers which of them occur in two different texts. Texts that
   equal one of a smaller id are found in the same exchange; they go wholly.
2. For each shared anchor a batch sends the bytes around it (84 at most, each distinct one once,
   with its least id). The owner reads the contexts as symbols of ``BLOCK`` bytes aligned at the
   anchor and builds the suffix array of all of them by linear grouping (``grouping``). Strings
   that agree in their full blocks are neighbours there; at each of the 35 offsets the bytes at
   both ends split these groups, a byte-by-byte check follows, and the answer says which strings
   a smaller id holds.
3. Batches turn the answers into removed spans.

The texts are shuffled once (the three passes read the same exchange); messages hold a few bytes
for each anchor. No pair of documents is ever formed, and a passage or a text that a third of all
documents share is one record in each batch.

Edge cases: null texts are empty; texts under ``LENGTH`` bytes lose nothing; equal ids do not
count as smaller than each other, a null id is larger than any other; repeated rows are answered
each; other columns may be carried along under their own names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, fresh_names, held, parts_of, placed, plain, shuffle_partitions
from .grouping import suffix_array

LENGTH = 50
ANCHOR = 16
REACH = LENGTH - ANCHOR  # bytes on either side of an anchor that a string with it can reach
OFFSETS = REACH + 1
CONTEXT = ANCHOR + 2 * REACH
BLOCK = 14  # a sixth of a context; every string of LENGTH bytes holds two blocks in full
OWNER_BYTES = 32 << 20  # of stored input for each owner of anchors; a batch has half of it
CONTEXTS_AT_ONCE = 40_000  # for one suffix array
NO_ID = np.iinfo(np.int64).max
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
MESSAGE = "to long, batch long, payload binary"


def _slide(x: np.ndarray, width: int, least) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = least(x[:-n], x[n:])
        n *= 2
    rest = width - n
    return least(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a text: at least one in every ``LENGTH`` bytes."""
    if len(data) < LENGTH:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    a = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    for step, m in zip((1, 2, 4, 8), _M):
        a = a[:-step] * m + a[step:]
        a ^= a >> np.uint64(29)
    a *= _M[0]
    a ^= a >> np.uint64(32)
    a *= _M[1]
    low = _slide(a, OFFSETS, np.minimum)
    edge = np.zeros(OFFSETS - 1, dtype=np.uint64)
    high = _slide(np.concatenate([edge, low, edge]), OFFSETS, np.maximum)
    at = np.flatnonzero(high == a)
    return at, a[at]


class Batch:
    """The texts of a batch in a fixed order, their anchors, and the owners of the anchors."""

    def __init__(self, ids: list, texts: list, owners: int) -> None:
        raw = [(NO_ID if i is None else i, (t or "").encode(), n) for n, (i, t) in enumerate(zip(ids, texts))]
        raw.sort(key=lambda r: r[:2])
        self.ids = np.array([r[0] for r in raw], dtype=np.int64)
        self.data = [r[1] for r in raw]
        self.row = [r[2] for r in raw]
        self.digest = [xxhash.xxh3_128_digest(d) for d in self.data]
        found = [anchors(d) for d in self.data]
        self.doc = np.repeat(np.arange(len(raw)), [len(f[0]) for f in found])
        self.at = np.concatenate([f[0] for f in found] or [np.zeros(0, dtype=np.int64)])
        self.hash = np.concatenate([f[1] for f in found] or [np.zeros(0, dtype=np.uint64)])
        self.owners = owners
        owner = (self.hash >> np.uint64(33)).astype(np.int64) % owners
        self.order = np.argsort(owner, kind="stable")  # anchors by owner, in text order
        self.cuts = np.searchsorted(owner[self.order], np.arange(owners + 1))
        self.home = np.array([int.from_bytes(d[:4], "little") % owners for d in self.digest], dtype=np.int64)

    def ask(self) -> Iterator[tuple[int, int, bytes]]:
        """Messages ``(owner, kind, payload)``: kind 0 anchors, kind 1 digests."""
        short = np.array([int.from_bytes(d[:8], "little") for d in self.digest], dtype=np.uint64)
        for o in range(self.owners):
            pick = self.order[self.cuts[o] : self.cuts[o + 1]]
            if len(pick):
                docs, sizes = np.unique(self.doc[pick], return_counts=True)
                head = np.array([len(pick), len(docs)], dtype=np.int64)
                yield o, 0, b"".join((head.tobytes(), self.hash[pick].tobytes(), short[docs].tobytes(), sizes.astype(np.uint32).tobytes()))
            own = np.flatnonzero(self.home == o)
            if len(own):
                yield o, 1, self.ids[own].tobytes() + b"".join(self.digest[i] for i in own)

    def hear(self, answers: dict[tuple[int, int], bytes]) -> None:
        """Takes the owners' first answers: which anchors are shared, which texts are copies."""
        self.copy = np.zeros(len(self.data), dtype=bool)
        shared = np.zeros(len(self.hash), dtype=bool)
        for o in range(self.owners):
            if (x := answers.get((0, o))) is not None:
                pick = self.order[self.cuts[o] : self.cuts[o + 1]]
                shared[pick] = np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=len(pick)).astype(bool)
            if (x := answers.get((1, o))) is not None:
                own = np.flatnonzero(self.home == o)
                self.copy[own] = np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=len(own)).astype(bool)
        shared &= ~self.copy[self.doc]
        self.picked = self.order[shared[self.order]]  # shared anchors by owner

    def collect(self) -> np.ndarray:
        """The contexts of the shared anchors; which record each is: equal contexts of an anchor are one."""
        self.context = np.zeros((len(self.picked), CONTEXT + 2), dtype=np.uint8)
        where = np.argsort(self.doc[self.picked], kind="stable")
        bounds = np.searchsorted(self.doc[self.picked][where], np.arange(len(self.data) + 1))
        span = np.arange(CONTEXT)
        for d in np.flatnonzero(np.diff(bounds)):
            rows = where[bounds[d] : bounds[d + 1]]
            at = self.at[self.picked[rows]]
            size = len(self.data[d])
            padded = np.frombuffer(bytes(REACH) + self.data[d] + bytes(REACH), dtype=np.uint8)
            self.context[rows, :CONTEXT] = padded[at[:, None] + span]
            self.context[rows, CONTEXT] = np.minimum(at, REACH)
            self.context[rows, CONTEXT + 1] = np.minimum(size - at - ANCHOR, REACH)
        seen: dict[bytes, int] = {}
        return np.fromiter((seen.setdefault(k, len(seen)) for k in map(bytes, self.context)), dtype=np.int64, count=len(self.picked))

    def records(self, record: np.ndarray) -> None:
        """Takes the record of each shared anchor; a record's id is its least one."""
        owner = (self.hash[self.picked] >> np.uint64(33)).astype(np.int64) % self.owners
        n = int(record.max()) + 1 if len(record) else 0
        first = np.full(n, len(self.picked), dtype=np.int64)
        np.minimum.at(first, record, np.arange(len(self.picked)))
        self.record, self.first, self.record_owner = record, first, owner[first] if n else owner[:0]
        self.record_id = np.full(n, NO_ID)
        np.minimum.at(self.record_id, record, self.ids[self.doc[self.picked]])

    def tell(self) -> Iterator[tuple[int, int, bytes]]:
        """Messages with the contexts of the shared anchors; kind 2."""
        for o in np.unique(self.record_owner):
            rec = np.flatnonzero(self.record_owner == o)
            top = self.first[rec]
            yield int(o), 2, b"".join((self.hash[self.picked[top]].tobytes(), self.record_id[rec].tobytes(), self.context[top].tobytes()))

    def spans(self, answers: dict[tuple[int, int], bytes]) -> list[np.ndarray]:
        """The removed spans ``[k, 2]`` of each text, after the second answers."""
        mask = np.zeros(len(self.first), dtype=np.uint64)
        for o in np.unique(self.record_owner):
            rec = np.flatnonzero(self.record_owner == o)
            if (x := answers.get((2, int(o)))) is not None:
                mask[rec] = np.frombuffer(x, dtype=np.uint64)
        later = self.ids[self.doc[self.picked]] > self.record_id[self.record]  # a smaller id of this batch has the whole context
        at = self.at[self.picked]
        size = np.array([len(d) for d in self.data], dtype=np.int64)
        left, right = np.minimum(at, REACH), np.minimum(size[self.doc[self.picked]] - at - ANCHOR, REACH)
        out: list[np.ndarray] = [np.zeros((0, 2), dtype=np.int64)] * len(self.data)
        bits = mask[self.record]
        found = []
        for j in range(OFFSETS):
            whole = later & (j >= REACH - left) & (j <= right)
            rows = np.flatnonzero(whole | (~later & ((bits >> np.uint64(j)) & np.uint64(1) > 0)))
            found.append((rows, np.full(len(rows), j)))
        rows, cols = (np.concatenate(x) for x in zip(*found))
        doc = self.doc[self.picked[rows]]
        start = self.at[self.picked[rows]] - REACH + cols
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        if len(doc):
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + LENGTH)])
            lo = np.flatnonzero(new)
            hi = np.concatenate([lo[1:], [len(doc)]]) - 1
            spans = np.stack([start[lo], start[hi] + LENGTH], 1)
            own = doc[lo]
            cut = np.searchsorted(own, np.arange(len(self.data) + 1))
            for d in np.unique(own):
                out[d] = spans[cut[d] : cut[d + 1]]
        for d in np.flatnonzero(self.copy):
            if len(self.data[d]) >= LENGTH:
                out[d] = np.array([[0, len(self.data[d])]])
        return out


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys together, and where each key begins in it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, dtype=np.int64)


def answer_anchors(payloads: list[bytes]) -> list[bytes]:
    """For each message of kind 0: a bit for each anchor that two different texts hold."""
    hashes, texts = [], []
    for p in payloads:
        n, d = np.frombuffer(p, dtype=np.int64, count=2)
        at = 16 + 8 * n
        hashes.append(np.frombuffer(p, dtype=np.uint64, count=n, offset=16))
        short = np.frombuffer(p, dtype=np.uint64, count=d, offset=at)
        texts.append(np.repeat(short, np.frombuffer(p, dtype=np.uint32, count=d, offset=at + 8 * d)))
    key, text = np.concatenate(hashes), np.concatenate(texts)
    order, begin = _groups(key)
    text = text[order]
    several = np.minimum.reduceat(text, begin) != np.maximum.reduceat(text, begin)
    bit = np.empty(len(key), dtype=bool)
    bit[order] = np.repeat(several, np.diff(np.append(begin, len(key))))
    cuts = np.cumsum([len(h) for h in hashes])[:-1]
    return [np.packbits(b).tobytes() for b in np.split(bit, cuts)]


def answer_digests(payloads: list[bytes]) -> list[bytes]:
    """For each message of kind 1: a bit for each text that a smaller id has too."""
    sizes = [len(p) // 24 for p in payloads]
    ids = np.concatenate([np.frombuffer(p, dtype=np.int64, count=n) for p, n in zip(payloads, sizes)])
    digests = np.concatenate([np.frombuffer(p, dtype="V16", offset=8 * n) for p, n in zip(payloads, sizes)])
    _, which = np.unique(digests.view("<u8").reshape(-1, 2), axis=0, return_inverse=True)
    which = which.reshape(-1)
    least = np.full(which.max() + 1, NO_ID)
    np.minimum.at(least, which, ids)
    return [np.packbits(b).tobytes() for b in np.split(least[which] < ids, np.cumsum(sizes)[:-1])]


def _block_keys(anchor: np.ndarray, body: np.ndarray, lo: int, hi: int, number: int) -> np.ndarray:
    """Hashes of the bytes ``lo:hi`` of contexts, told apart by anchor and by number."""
    seed = np.uint64((number + 1) * int(_M[2]) & 0xFFFFFFFFFFFFFFFF)  # modulo 2^64, as arrays wrap
    out = anchor * _M[3] + seed if hi > lo else np.zeros(len(anchor), dtype=np.uint64)
    for i in range(lo, hi):
        out = (out ^ body[:, i]) * _M[0]
        out ^= out >> np.uint64(29)
    return out


def _repeated(keys: np.ndarray) -> np.ndarray:
    order, begin = _groups(keys)
    size = np.diff(np.append(begin, len(keys)))
    out = np.zeros(len(keys), dtype=bool)
    out[order] = np.repeat(size > 1, size)
    return out


def _block_groups(anchor: np.ndarray, body: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """``_groups_of`` for contexts in order of their anchors, some anchors at a time: contexts of
    different anchors have no symbol in common, so suffix arrays of parts order them as one would,
    in a bounded memory."""
    new = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
    cuts = np.unique(np.append(new[np.minimum(np.searchsorted(new, np.arange(0, len(anchor), CONTEXTS_AT_ONCE)), len(new) - 1)], [0, len(anchor)]))
    parts = [(a, _groups_of(anchor[a:b], body[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    return {k: np.concatenate([p[k] + 2 * a for a, p in parts]) for k in parts[0][1]}


def _groups_of(anchor: np.ndarray, body: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """For each block and number of blocks that a string can hold in full: a number for each
    context, equal where anchors and these blocks are.

    Contexts are aligned at their anchor, so they are read as symbols of ``BLOCK`` bytes, a
    fraction of the bytes. A string holds two blocks in full at least, so only runs of two or more
    blocks that occur elsewhere too are kept, with a least symbol after each run. The suffix array
    of all runs is built by linear grouping; suffixes that agree in the blocks are neighbours in it.
    """
    n, blocks = len(body), CONTEXT // BLOCK
    keys = np.stack([_block_keys(anchor, body, b * BLOCK, (b + 1) * BLOCK, b) for b in range(blocks)], 1)
    shared = _repeated(keys.reshape(-1)).reshape(n, blocks)
    pair = shared[:, :-1] & shared[:, 1:]
    inside = np.zeros((n, blocks + 1), dtype=bool)  # blocks that occur twice and stand by another such one
    inside[:, : blocks - 1] |= pair
    inside[:, 1:blocks] |= pair
    cut = np.zeros_like(inside)  # a least symbol after each run of them
    cut[:, 1:] = inside[:, :-1] & ~inside[:, 1:]
    taken = (inside | cut).reshape(-1)
    text = np.zeros((n, blocks + 1), dtype=np.int64)
    chosen = inside[:, :blocks]
    text[:, :blocks][chosen] = np.unique(keys[chosen], return_inverse=True)[1] + 1
    spot = np.flatnonzero(taken)
    order = spot[np.array(suffix_array(text.reshape(-1)[spot]), dtype=np.int64)]
    flat, within = text.reshape(-1), inside.reshape(-1)
    out: dict[tuple[int, int], np.ndarray] = {}
    for first, many in sorted({(-(-j // BLOCK), (j + LENGTH) // BLOCK - -(-j // BLOCK)) for j in range(OFFSETS)}):
        at = order[order % (blocks + 1) == first]  # in suffix order; a symbol belongs to one block
        for t in range(many):
            at = at[within[at + t]]
        differ = np.zeros(len(at), dtype=bool)
        for t in range(many):
            differ[1:] |= flat[at[1:] + t] != flat[at[:-1] + t]
        number = np.arange(n) + n  # a context without these blocks is like no other one
        number[at // (blocks + 1)] = np.cumsum(differ)
        out[first, many] = number
    return out


def answer_contexts(payloads: list[bytes]) -> list[bytes]:
    """For each message of kind 2: of each context, a mask of the offsets whose ``LENGTH``-byte
    string a smaller id holds as well."""
    width = 16 + CONTEXT + 2
    sizes = [len(p) // width for p in payloads]
    anchor = np.concatenate([np.frombuffer(p, dtype=np.uint64, count=n) for p, n in zip(payloads, sizes)])
    ids = np.concatenate([np.frombuffer(p, dtype=np.int64, count=n, offset=8 * n) for p, n in zip(payloads, sizes)])
    context = np.concatenate([np.frombuffer(p, dtype=np.uint8, offset=16 * n).reshape(n, CONTEXT + 2) for p, n in zip(payloads, sizes)])
    mask = np.zeros(len(anchor), dtype=np.uint64)
    order, begin = _groups(anchor)
    several = np.diff(np.append(begin, len(anchor))) > 1
    keep = order[np.repeat(several, np.diff(np.append(begin, len(anchor))))]
    anchor_k, body = anchor[keep], context[keep]
    left, right = body[:, CONTEXT].astype(np.int64), body[:, CONTEXT + 1].astype(np.int64)
    # a string of LENGTH bytes reaches half of REACH on one side of its anchor at least
    half = (REACH + 1) // 2
    ahead, behind = (_block_keys(anchor_k, body, lo, lo + half, n) for n, lo in enumerate((REACH + ANCHOR, REACH - half)))
    near = _repeated(ahead) | _repeated(behind)
    keep, anchor_k, body, left, right = keep[near], anchor_k[near], body[near], left[near], right[near]
    ids_k = ids[keep]
    found = np.zeros(len(keep), dtype=np.uint64)
    if len(keep) > 1:
        same_blocks = _block_groups(anchor_k, body)
    for j in range(OFFSETS if len(keep) > 1 else 0):
        valid = np.flatnonzero((j >= REACH - left) & (j <= right))
        if len(valid) < 2:
            continue
        first, last = -(-j // BLOCK), (j + LENGTH) // BLOCK
        head, tail = (_block_keys(anchor_k[valid], body[valid], lo, hi, n) for n, (lo, hi) in enumerate(((j, first * BLOCK), (last * BLOCK, j + LENGTH))))
        string = (same_blocks[first, last - first][valid].astype(np.uint64) * _M[0] ^ head) * _M[2] + tail * _M[3]
        order, begin = _groups(string)
        row = valid[order]
        size = np.diff(np.append(begin, len(row)))
        least = np.repeat(np.minimum.reduceat(ids_k[row], begin), size)
        smaller = least < ids_k[row]
        if smaller.any():
            top = np.repeat(row[begin], size)[smaller]
            row = row[smaller]
            same = (body[row, j : j + LENGTH] == body[top, j : j + LENGTH]).all(1)
            found[row[same]] |= np.uint64(1 << j)
    mask[keep] = found
    return [m.tobytes() for m in np.split(mask, np.cumsum(sizes)[:-1])]


def _messages(rows: list[tuple]) -> pa.Table:
    """One row for each pair of a batch and an owner: ``(to, batch, parts)`` with parts by kind."""
    packed = [(to, batch, b"".join(np.array([k, len(p)], dtype=np.int64).tobytes() + p for k, p in parts)) for to, batch, parts in rows]
    columns = list(zip(*packed)) or [(), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["to", "batch", "payload"])


def _parts(payload: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(payload):
        kind, size = np.frombuffer(payload, dtype=np.int64, count=2, offset=at).tolist()
        yield kind, payload[at + 16 : at + 16 + size]
        at += 16 + size


def _by_owner(found: Iterator[tuple[int, int, bytes]], batch: int) -> list[tuple]:
    rows: dict[int, list] = {}
    for owner, kind, payload in found:
        rows.setdefault(owner, []).append((kind, payload))
    return [(o, batch, parts) for o, parts in rows.items()]


def _heard(table: pa.Table, number: dict[int, int]) -> dict[tuple[int, int], bytes]:
    """Answers by kind and owner's number."""
    return {(kind, number[o]): part for o, p in zip(table.column("to").to_pylist(), table.column("payload").to_pylist()) for kind, part in _parts(p)}


def repeated_spans(docs: DataFrame, finish, schema: str, text: str = "text", key: str = "doc_id", carry: list[str] = ()) -> DataFrame:
    """Runs ``finish(rows, batch, spans)`` on each batch, where ``rows`` is an Arrow table with the
    carried columns, ``batch.row`` maps its texts to rows and ``spans`` are the removed byte spans."""
    spark = docs.sparkSession
    owners = parts_of(docs, OWNER_BYTES)
    address = placed(owners, shuffle_partitions(spark)).tolist()
    number = {a: o for o, a in enumerate(address)}
    n_batch, n_id, n_text = fresh_names(list(carry), "_batch", "_id", "_text")
    which = F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`")), F.lit(2 * owners))
    source = docs.select(dealt(which, 2 * owners, spark).alias(n_batch), F.col(f"`{key}`").cast("long").alias(n_id), F.col(f"`{text}`").alias(n_text), *[F.col(f"`{c}`") for c in carry]).groupBy(n_batch)

    def load(table: pa.Table) -> Batch:
        held("repeats", 0, lambda: None)
        return Batch(table.column(n_id).to_pylist(), table.column(n_text).to_pylist(), owners)

    def send(found: Iterator[tuple[int, int, bytes]], batch: int) -> pa.Table:
        return _messages([(address[o], b, parts) for o, b, parts in _by_owner(found, batch)])

    def ask(table: pa.Table) -> pa.Table:
        return send(load(table).ask(), table.column(n_batch)[0].as_py())

    def reply(table: pa.Table) -> pa.Table:
        batches, owner = table.column("batch").to_pylist(), table.column("to")[0].as_py()
        told = [dict(_parts(p)) for p in table.column("payload").to_pylist()]
        out: list[list] = [[] for _ in told]
        for kind, answer in ((0, answer_anchors), (1, answer_digests), (2, answer_contexts)):
            pick = [i for i, t in enumerate(told) if kind in t]
            if pick:
                for i, a in zip(pick, answer([told[i][kind] for i in pick])):
                    out[i].append((kind, a))
        for t, parts in zip(told, out):
            if 3 in t:
                parts.append((3, t[3]))
        return _messages([(owner, b, parts) for b, parts in zip(batches, out)])

    def tell(table: pa.Table, heard: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _messages([])
        n, batch = table.column(n_batch)[0].as_py(), load(table)
        first = _heard(heard, number)
        batch.hear(first)
        record = batch.collect()
        batch.records(record)
        # the first answers and the records travel on to the last pass
        first[3, 0] = np.diff(record, prepend=0).astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()
        passed = b"".join(np.array([k, o, len(p)], dtype=np.int64).tobytes() + p for (k, o), p in first.items())
        return send([*batch.tell(), (n % owners, 3, passed)], n)

    def end(table: pa.Table, heard: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], f.type) for f in empty], schema=empty)
        batch, second = load(table), _heard(heard, number)
        first, at = {}, 0
        passed = next(p for (k, _), p in second.items() if k == 3)
        while at < len(passed):
            k, o, size = np.frombuffer(passed, dtype=np.int64, count=3, offset=at).tolist()
            first[k, o] = passed[at + 24 : at + 24 + size]
            at += 24 + size
        batch.hear(first)
        batch.records(np.cumsum(np.ascontiguousarray(np.frombuffer(first[3, 0], dtype=np.uint8).reshape(4, -1).T).view(np.int32).reshape(-1), dtype=np.int64))
        return finish(table, batch, batch.spans(second)).cast(empty)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    empty = to_arrow_schema(_parse_datatype_string(schema))
    asked = source.applyInArrow(ask, MESSAGE)
    first = asked.groupBy("to").applyInArrow(reply, MESSAGE)
    told = source.cogroup(first.groupBy("batch")).applyInArrow(tell, MESSAGE)
    second = told.groupBy("to").applyInArrow(reply, MESSAGE)
    return source.cogroup(second.groupBy("batch")).applyInArrow(end, schema)


def _kept(data: bytes, spans: np.ndarray) -> bytes:
    at, out = 0, []
    for lo, hi in spans.tolist():
        out.append(data[at:lo])
        at = hi
    return b"".join([*out, data[at:]])


def op1(docs: DataFrame) -> DataFrame:
    """The contract's rows."""

    def finish(table: pa.Table, batch: Batch, spans: list[np.ndarray]) -> pa.Table:
        ids = [None if i == NO_ID else int(i) for i in batch.ids]
        gone = [int((s[:, 1] - s[:, 0]).sum()) for s in spans]
        digest = [hashlib.sha256(_kept(d, s)).hexdigest() for d, s in zip(batch.data, spans)]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(map(len, batch.data), pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(map(len, spans), pa.int64()), "kept_sha256": pa.array(digest, pa.string())})

    return repeated_spans(docs, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents, all columns kept, with the repeated strings taken out of their texts;
    characters that a cut splits go with it. A document that is left empty goes."""
    place = docs.columns.index(text)
    rows = plain(docs)
    columns = rows.columns
    carry = [c for c in columns if c != columns[place]]

    def finish(table: pa.Table, batch: Batch, spans: list[np.ndarray]) -> pa.Table:
        texts: list = [None] * table.num_rows
        for i, row in enumerate(batch.row):
            texts[row] = _kept(batch.data[i], spans[i]).decode("utf-8", "ignore")
        out = table.select(carry).add_column(place, columns[place], pa.array(texts, pa.string()))
        return out.filter(pa.array([bool(t.strip()) for t in texts], pa.bool_()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return repeated_spans(rows, finish, schema, columns[place], columns[docs.columns.index(key)], carry).toDF(*docs.columns)
