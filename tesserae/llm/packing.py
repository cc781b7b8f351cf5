"""Packing of token streams into fixed windows by order-preserving dynamic programming.

The documents of a partition form one stream in their order. A window may end at a document end
(free), at a sentence end or, in long sentences, at spots inside (both penalised). With ``P(j)``
the penalty of a cut at token ``j`` and windows of at most ``W`` tokens,

    f(j) = P(j) + W - j + min over j - W <= i < j of (f(i) + i),

a sliding-window minimum that a monotone queue gives in constant amortised time, so a block's
optimal cuts cost linear time. A stream's last tokens may end in windows whose lengths are powers
of two, which need no padding. Blocks of ``block_tokens`` bound memory; the undecided tail of a
block opens the next one.

The operator is map-only. Sequence ids are the partition's number and a running number in it.

Edge cases: a null or empty text is one end token; documents of any length are cut over many
windows; repeated rows are packed each; an empty table gives no rows; columns other than the id
and text are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Interner, Memo, held

WINDOW = 4096
END_ID = 2
SENTENCE, INSIDE = 4.0, 20.0
SPOT = 64
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words on which the short cut of the tokenizer has to equal the tokenizer itself.
_PROBES = ("Word", "WORDS,", "a", "l\u2019\u00e9t\u00e9", "\u00c9tranger", "na\u00efve.", "stra\u00dfe", "\u65e5\u672c\u8a9e", "it's", "x2", "\u0130stanbul")
BLOCK_CHARS = 300_000
_ENDS = (".", "!", "?", "。", "…")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, sequence_length long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte: itself where it is
    printable, else the next code point from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """Token ids of whole texts for a tokenizer that drops white space and so never joins what it
    separates: each distinct word is encoded once and its ids are looked up afterwards.

    A word of letters and trailing ASCII punctuation, the common case, is two pre-tokens; its
    lower-case letters go straight to the BPE model and are remembered for all its spellings.
    Any other word goes through the whole tokenizer. A tokenizer for which that does not hold
    raises ``ValueError``.
    """

    def __init__(self, path: str, limit: int = 450_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.words = Interner(limit)
        self.cores = Memo(self._core, limit * 3 // 4)
        self.tails = Memo(self._whole, 50_000)
        self._clear()
        for word in _PROBES:
            if self._word(word) != self._whole(word):
                raise ValueError(f"{path} does not lower-case words of letters and merge their bytes: {word!r} differs")
        if self._whole(" ".join(_PROBES)) != b"".join(map(self._whole, _PROBES)):
            raise ValueError(f"{path} joins what white space separates")

    def _clear(self) -> None:
        self.words.reset()
        self.ids = np.zeros(1 << 16, dtype="<u4")
        self.begin = np.zeros(1 << 14, dtype=np.int64)
        self.size = np.zeros(1 << 14, dtype=np.int64)
        self.ends = np.zeros(1 << 14, dtype=bool)
        self.used = 0

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _core(self, low: str) -> bytes:
        spelled = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _word(self, word: str) -> bytes:
        core = word if word.isalpha() else word.rstrip(_PUNCTUATION)
        if core.isascii():
            if core.isalpha() and len(core) < 200:
                low = self.cores[core.lower()]
                return low if core is word else low + self.tails[word[len(core) :]]
        elif core.isalpha() and "\u03a3" not in core and len(core) < 200 and unicodedata.is_normalized("NFC", core):
            low = core.lower()
            if low.isalpha():
                return self.cores[low] + self.tails[word[len(core) :]]
        return self._whole(word)

    def _learn(self) -> None:
        fresh = self.words.take_fresh()
        if not fresh:
            return
        rows = list(map(self._word, fresh))
        sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)) // 4
        need, first = len(self.words), len(self.words) - len(fresh)
        while len(self.size) < need:
            self.begin, self.size, self.ends = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size, self.ends))
        total = int(sizes.sum())
        while len(self.ids) < self.used + total:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = np.frombuffer(b"".join(rows), dtype="<u4")
        self.begin[first:need] = self.used + np.cumsum(sizes) - sizes
        self.size[first:need] = sizes
        self.ends[first:need] = [w.endswith(_ENDS) for w in fresh]
        self.used += total

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text the ids, and the number of ids up to the end of each word that ends a sentence."""
        if self.words.full:
            self._clear()
        rows = []
        for text in texts:
            odd = any(x in text for x in _SEPARATORS)
            rows.append(np.fromiter(map(self.words.__getitem__, filter(None, _SPACE.split(text)) if odd else text.split()), dtype=np.int64))
        self._learn()
        flat = np.concatenate(rows)
        size = self.size[flat]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.ids[np.arange(total) + np.repeat(self.begin[flat] - (upto - size), size)]
        word = np.cumsum([0, *map(len, rows)])
        at = np.concatenate([[0], upto])[word]
        spots = np.flatnonzero(self.ends[flat])
        cut, ends = np.searchsorted(spots, word), upto[spots]
        return [(ids[a:b], ends[c:d] - a) for a, b, c, d in zip(at[:-1].tolist(), at[1:].tolist(), cut[:-1].tolist(), cut[1:].tolist())]


def candidates(doc_sizes: np.ndarray, sentence_ends: np.ndarray, spot: int = SPOT) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions in a block, ascending, and their penalties. Gaps of over ``spot`` tokens
    get a spot inside every ``spot`` tokens."""
    doc_ends = np.cumsum(doc_sizes)
    spots = np.concatenate([doc_ends, sentence_ends])
    kinds = np.concatenate([np.zeros(len(doc_ends)), np.full(len(sentence_ends), SENTENCE)])
    order = np.argsort(spots, kind="stable")
    at, penalty = spots[order], kinds[order]
    first = np.concatenate([[True], at[1:] != at[:-1]]) & (at > 0)  # a document's end comes before a sentence's
    at, penalty = at[first], penalty[first]
    before = np.concatenate([[0], at[:-1]])
    more = np.maximum((at - before - 1) // spot, 0)
    if more.sum():
        k = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        own = np.arange(len(at)) + np.cumsum(more)
        both, cost = np.empty(len(at) + len(k), dtype=np.int64), np.full(len(at) + len(k), INSIDE)
        inside = np.ones(len(both), dtype=bool)
        inside[own] = False
        both[own], cost[own] = at, penalty
        both[inside] = np.repeat(before, more) + spot * (k + 1)
        at, penalty = both, cost
    return at, penalty


def choose_cuts(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW, *, final: bool = True) -> list[int]:
    """Optimal window ends. With ``final`` they reach the block's end, where a tail of several
    windows of power-of-two lengths may replace a padded one; else they stop at the best
    candidate in the last window, and the rest is left to the next block."""
    pos, pen = at.tolist(), penalty.tolist()
    n = len(pos)
    if not n:
        return []
    end = pos[-1]
    cost, back = [0.0] * n, [0] * n
    queue_pos, queue_key, queue_at = [0], [0.0], [-1]  # keys f(i) + i rise from head to tail
    head = 0
    for j in range(n):
        p = pos[j]
        low = p - window
        while queue_pos[head] < low:
            head += 1
        c = cost[j] = pen[j] + window - p + queue_key[head]
        back[j] = queue_at[head]
        key = c + p
        while len(queue_key) > head and queue_key[-1] >= key:
            queue_pos.pop()
            queue_key.pop()
            queue_at.pop()
        queue_pos.append(p)
        queue_key.append(key)
        queue_at.append(j)
        if head > 4096:
            del queue_pos[:head], queue_key[:head], queue_at[:head]
            head = 0
    tail: list[int] = []
    if final:
        best, stop = cost[-1], n - 1
        for j in range(n - 1, -2, -1):
            p = pos[j] if j >= 0 else 0
            length = end - p
            if length > window:
                break
            if length and (c := (cost[j] if j >= 0 else 0.0) + (length.bit_count() - 1) * INSIDE) < best:
                best, stop = c, j
        if stop != n - 1:
            p = pos[stop] if stop >= 0 else 0
            length = end - p
            for bit in range(length.bit_length() - 1, -1, -1):
                if length >> bit & 1:
                    p += 1 << bit
                    tail.append(p)
    else:
        stop = min((j for j in range(n - 1, -1, -1) if pos[j] > end - window), key=lambda j: cost[j] + 0.002 * (end - pos[j]))
    cuts = []
    while stop >= 0:
        cuts.append(pos[stop])
        stop = back[stop]
    return cuts[::-1] + tail


class _Stream:
    """The documents that wait to be packed, and where the next sequence's number stands."""

    def __init__(self, window: int, base: int) -> None:
        self.window, self.next = window, base
        self.docs: list[tuple] = []  # id, ids, sentence ends, tokens before, tokens in all
        self.tokens = 0

    def add(self, doc_id, ids: np.ndarray, ends: np.ndarray) -> None:
        self.docs.append((doc_id, ids, ends, 0, len(ids)))
        self.tokens += len(ids)

    def flush(self, final: bool) -> list[tuple]:
        if not self.docs:
            return []
        sizes = np.array([len(d[1]) for d in self.docs], dtype=np.int64)
        stop = np.cumsum(sizes)
        begin = stop - sizes
        ends = np.concatenate([d[2] + b for d, b in zip(self.docs, begin)])
        cuts = np.array(choose_cuts(*candidates(sizes, ends), self.window, final=final), dtype=np.int64)
        done = int(cuts[-1])
        edges = np.sort(np.concatenate([[0], cuts, stop[stop <= done]]))
        edges = edges[np.concatenate([[True], edges[1:] != edges[:-1]])]
        left, right = edges[:-1], edges[1:]
        doc = np.searchsorted(stop, left, side="right")
        seq = np.searchsorted(cuts, left, side="right")
        opened = np.concatenate([[0], cuts])
        lengths = np.diff(opened)
        out = []
        for a, b, d, s in zip(left.tolist(), right.tolist(), doc.tolist(), seq.tolist()):
            doc_id, ids, _, before, total = self.docs[d]
            lo = a - int(begin[d])
            piece = ids[lo : lo + b - a]
            out.append((doc_id, before + lo, b - a, zlib.crc32(piece), total, self.next + s, a - int(opened[s]), int(lengths[s]), piece))
        self.next += len(cuts)
        k = int(np.searchsorted(stop, done, side="right"))
        rest = self.docs[k:]
        if rest and (lo := done - int(begin[k])) > 0:
            doc_id, ids, e, before, total = rest[0]
            rest[0] = (doc_id, ids[lo:], e[e > lo] - lo, before + lo, total)
        self.docs, self.tokens = rest, int(sizes.sum()) - done
        return out


def pack(
    docs: DataFrame, text: str = "text", key: str = "doc_id", *, window: int = WINDOW, tokenizer: str | None = None, end_id: int = END_ID, block_tokens: int = 1 << 20, with_ids: bool = False
) -> DataFrame:
    """One row a piece; with ``with_ids`` also the piece's token ids."""
    path = tokenizer or default_tokenizer()
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    kinds = [pa.int64()] * 8 + [pa.list_(pa.int32())] * with_ids
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"] + ["ids"] * with_ids

    def rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(found), 20_000):
            part = list(zip(*found[lo : lo + 20_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds)], names=fields)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held("packing", path, lambda: WordTokenizer(path))
        stream = _Stream(window, TaskContext.get().partitionId() << 33)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            lo = 0
            while lo < len(names):
                block, amount = [], 0
                while lo + len(block) < len(names) and amount < BLOCK_CHARS:
                    block.append(texts[lo + len(block)].as_py() or "")
                    amount += len(block[-1])
                for doc_id, (ids, ends) in zip(names[lo:], words.encode(block)):
                    stream.add(doc_id, np.concatenate([ids, end]), ends)
                    if stream.tokens >= max(block_tokens, 4 * window):  # a block holds some windows, of which the last may wait
                        yield from rows(stream.flush(False))
                lo += len(block)
        yield from rows(stream.flush(True))

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(apply, schema)


def op3(docs: DataFrame) -> DataFrame:
    return pack(docs)
