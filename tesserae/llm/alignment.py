"""Alignment of two tokenizers' encodings of the same texts.

The tokens of B are a static interval index: their byte ranges, in order. Each token of A stabs it by
bisection for the tokens of B that it overlaps (the links); a gap between tokens of B that no token
of A spans is a boundary, and what lies between boundaries is a group.

Both tokenizers start anew before a run of white space, so a text is cut there into units, and a
boundary lies at each cut. A block of documents encodes and aligns each distinct unit once and adds
up what its documents hold. How many documents link a pair of ids is counted over the corpus: a
block sends its distinct pairs with its number of documents once, pairs are added up, and the block
gets the sums of its own pairs back. Nothing of the corpus is collected or broadcast but the best
count of each id of A, of which there are as many as the vocabulary has.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Interner, bound_batches, held, staged

#: White space by Unicode, as the tokenizers know it.
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
MARK = "▁"
_PROBE = "a  b\t\ufb01\u3000\u2163\n e\u0301 "
#: What splits a text before byte-level merges where the tokenizer's file names no other pattern.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text that a block holds, but for a single longer text.
BLOCK_BYTES = 4 << 20
UNITS_AT_ONCE = 1 << 14
SHIFT = 20
LINES, UNITS, PAIRS = 0, 1, 2
FACTS = ("n_a", "n_b", "n_groups", "n_links")
_NONE = np.zeros(0, dtype=np.int64)


def default_a() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_b() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ByteTokenizer:
    """A byte-level BPE file without a normaliser, run by its merge ranks. Special tokens are plain
    text. A file of another kind raises ``ValueError``."""

    def __init__(self, path: str) -> None:
        import tiktoken

        from .packing import byte_letters

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if spec.get("normalizer") or model.get("type", "BPE") != "BPE" or odd or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path} is no plain byte-level BPE")
        special = {t["id"] for t in spec.get("added_tokens", ())}
        letter = {c: b for b, c in byte_letters().items()}
        raw = lambda token: bytes(map(letter.__getitem__, token))
        ranks = {raw(token): i for token, i in model["vocab"].items() if i not in special}
        merged = [ranks[raw("".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
        if len(merged) + 256 != len(ranks) or any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError(f"the ids of {path} are not in the order of its merges")
        self.run = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes[i] = b

    def encode(self, units: list[str]) -> list[list[int]]:
        return list(map(self.run, units))  # no threads


class PieceTokenizer:
    """A piece model that puts a space before a text; a piece's bytes are its characters with the
    mark as space, or the byte that it names.

    ``cuts`` are the white-space characters before which encoding starts anew: no piece has one
    behind another character. A model that changes what it reads has none.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        pieces = [self.model.id_to_piece(i) for i in ids]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in zip(ids, pieces)]
        plain = [p for i, p in zip(ids, pieces) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        self.mark = self.model.piece_to_id(MARK)
        inside = {c for p in plain for k, c in enumerate(p) if k and c != p[k - 1]}
        joined = b"".join(self.bytes[i] for i in self.model.encode(_PROBE))
        same = joined == b" " + _PROBE.encode()
        self.cuts = "".join(c for c in WHITE if (MARK if c == " " else c) not in inside) if same else ""

    def encode(self, units: list[str]) -> list[list[int]]:
        """Of units that begin with a space, which stands for the one that the model adds, or with
        other white space, before which the model's own is taken off again. The model puts no space
        before an empty text, so a space alone is the mark."""
        out = self.model.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [[self.mark] if u == " " else ids if u[0] == " " else ids[1:] for u, ids in zip(units, out)]


def unit_pattern(cuts: str) -> re.Pattern:
    """Splits a text before runs of white space that begin with one of ``cuts``."""
    other = "".join(c for c in WHITE if c not in cuts)
    more = f"(?:[{other}][{WHITE}]*[^{WHITE}]*)*" if other else ""
    return re.compile(f"[{WHITE}]*[^{WHITE}]+{more}|[{WHITE}]+")


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two ways to cut the same bytes, by the ascending ends of their tokens: the links ``(a, b)``
    of tokens whose ranges overlap, and whether a boundary follows each token of B."""
    a_start, b_start = (np.concatenate([e[:0], [0][: len(e)], e[:-1]]).astype(np.int64) for e in (a_end, b_end))
    first = np.searchsorted(b_end, a_start, side="right")
    n = np.searchsorted(b_start, a_end, side="left") - first
    a = np.repeat(np.arange(len(a_end)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    spans = np.zeros(len(b_end) + 1, dtype=np.int64)  # a token of A spans the gaps after all but its last link
    np.add.at(spans, first, 1)
    np.add.at(spans, first + n - 1, -1)
    return a, b, np.cumsum(spans)[: len(b_end)] == 0


class Aligner:
    """Two tokenizers, and what a block of documents says of its units, documents and pairs."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteTokenizer(path_a), PieceTokenizer(path_b)
        self.sizes = [np.array(list(map(len, t.bytes)), dtype=np.int64) for t in (self.a, self.b)]
        self.split = unit_pattern(self.b.cuts).findall
        if max(map(len, self.sizes)) > 1 << SHIFT:
            raise ValueError(f"vocabularies are limited to {1 << SHIFT} ids")
        ids = [[str(i) for i in range(len(s))] for s in self.sizes]
        self.spelled = [x + end for n, last in zip(ids, "|;") for end in ("," + last) for x in n]
        self.starts = [0, len(ids[0]), 2 * len(ids[0]), 2 * len(ids[0]) + len(ids[1])]

    def _same(self, raw: list[bytes], pair: list[list[list[int]]]) -> bool:
        """Whether both encodings of all units give their bytes: each unit's length and all bytes together."""
        sizes, whole = list(map(len, raw)), b"".join(raw)
        for t, size, rows in zip((self.a, self.b), self.sizes, pair):
            flat = list(chain.from_iterable(rows))
            upto = np.concatenate([[0], np.cumsum(size[np.array(flat, dtype=np.int64)])])
            ends = np.cumsum([0, *map(len, rows)])
            if (np.diff(upto[ends]) != sizes).any() or b"".join(map(t.bytes.__getitem__, flat)) != whole:
                return False
        return True

    def _encoded(self, units: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """The ids of all units by each tokenizer, how many each unit has, and whether both give the
        unit's bytes; of a unit that one does not, there are none. A few units at a time."""
        ids, sizes, good = ([], []), ([], []), np.ones(len(units), dtype=bool)
        for lo in range(0, len(units), UNITS_AT_ONCE):
            part = units[lo : lo + UNITS_AT_ONCE]
            pair = [t.encode(part) for t in (self.a, self.b)]
            raw = [u.encode() for u in part]
            if not self._same(raw, pair):
                for n, (want, x, y) in enumerate(zip(raw, *pair)):
                    if not self._same([want], [[x], [y]]):
                        good[lo + n], pair[0][n], pair[1][n] = False, [], []
            for k, rows in enumerate(pair):
                sizes[k].append(np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)))
                ids[k].append(np.fromiter(chain.from_iterable(rows), dtype=np.int32))
        return [np.concatenate(x).astype(np.int64) for x in ids], [np.concatenate(x) for x in sizes], good

    def _spelled(self, order: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The groups of each unit, whose tokens are ``order`` in their groups' order."""
        out, stops = [], np.cumsum(sizes)
        for lo in range(0, len(sizes), UNITS_AT_ONCE):
            ends = stops[lo : lo + UNITS_AT_ONCE]
            first = int(stops[lo - 1]) if lo else 0
            words = list(map(self.spelled.__getitem__, order[first : ends[-1]].tolist()))
            cuts = [0, *(ends - first).tolist()]
            out += ["".join(words[x:y]) for x, y in zip(cuts, cuts[1:])]
        return out

    def units(self, units: list[str]) -> Units:
        if not units:
            return Units(np.ones(0, dtype=bool), *[_NONE] * 6, [])
        ids, n, good = self._encoded(units)
        ends = [np.cumsum(size[i]) for size, i in zip(self.sizes, ids)]
        a, b, closes = overlaps(*ends)
        bounds = ends[1][closes]
        of = [np.searchsorted(bounds, e) for e in ends]  # a token's group
        held_by = [np.bincount(o, minlength=len(bounds)) for o in of]
        before_b, upto_a = np.cumsum(held_by[1]) - held_by[1], np.cumsum(held_by[0])
        order = np.empty(len(ids[0]) + len(ids[1]), dtype=np.int64)
        order[np.arange(len(ids[0])) + before_b[of[0]]] = ids[0] + np.where(bounds[of[0]] == ends[0], self.starts[1], self.starts[0])
        order[np.arange(len(ids[1])) + upto_a[of[1]]] = ids[1] + np.where(closes, self.starts[3], self.starts[2])
        spelled = self._spelled(order, n[0] + n[1])
        own = [np.repeat(np.arange(len(units)), k) for k in n]
        links = np.bincount(own[0][a], minlength=len(units))
        pairs, place = np.unique((ids[0][a] << SHIFT) | ids[1][b], return_inverse=True)
        return Units(good, n[0], n[1], np.bincount(own[1][closes], minlength=len(units)), links, pairs, place.astype(np.int32), spelled)


@dataclass(frozen=True)
class Units:
    """Of each distinct unit: its tokens, groups and links, and its links' places among ``pairs``."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    pairs: np.ndarray
    place: np.ndarray
    spelled: list[str]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all the ranges ``[start, start + size)``, one after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _rows(kind: int, block: int, count: int, **columns) -> pa.RecordBatch:
    made = {"block": pa.array(np.full(count, block)), "kind": pa.array(np.full(count, kind, dtype=np.int32))} | columns
    return pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else pa.nulls(count, f.type) for f in _SAID], schema=_SAID)


_SAID = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in FACTS], ("groups_sha256", pa.string()), ("xs", pa.list_(pa.int32())), ("ys", pa.list_(pa.int32())), ("pair", pa.int64()), ("n", pa.int32())])
SAID = "block long, kind int, doc_id long, " + ", ".join(f"{c} long" for c in FACTS) + ", groups_sha256 string, xs array<int>, ys array<int>, pair long, n int"


def told(aligner: Aligner, block: int, docs: list[tuple], units: list[str]) -> Iterator[pa.RecordBatch]:
    """A block's messages: a line a document with its distinct units and how often it has each; the
    links of all units; and each pair with the number of documents that link it."""
    u = aligner.units(units)
    starts = np.cumsum(u.n_links) - u.n_links
    holds = np.zeros(len(u.pairs), dtype=np.int64)
    facts, digests, xs, ys = [], [], [], []
    for _, own in docs:
        if not len(own) or not u.good[own].all():
            facts.append((0, 0, 0, 0))
            digests.append("")
            xs.append(())
            ys.append(())
            continue
        facts.append(tuple(int(x[own].sum()) for x in (u.n_a, u.n_b, u.n_groups, u.n_links)))
        digests.append(hashlib.sha256("".join(map(u.spelled.__getitem__, own.tolist()))[:-1].encode()).hexdigest())
        distinct, times = np.unique(own, return_counts=True)
        holds[np.unique(u.place[ranges(starts[distinct], u.n_links[distinct])])] += 1
        xs.append(distinct.astype(np.int32))
        ys.append(times.astype(np.int32))
    columns = {c: pa.array([f[k] for f in facts], pa.int64()) for k, c in enumerate(FACTS)}
    lists = {c: pa.array(v, pa.list_(pa.int32())) for c, v in (("xs", xs), ("ys", ys))}
    yield _rows(LINES, block, len(docs), doc_id=pa.array([d[0] for d in docs], pa.int64()), groups_sha256=pa.array(digests, pa.string()), **columns, **lists)
    some = holds > 0
    place = (np.cumsum(some) - 1)[u.place]  # pairs of no document are left out; no good unit's document needs them
    yield _rows(UNITS, block, 1, xs=pa.array([u.n_links], pa.list_(pa.int32())), ys=pa.array([place], pa.list_(pa.int32())))
    for lo in range(0, len(u.pairs[some]), 1 << 16):
        yield _rows(PAIRS, block, len(u.pairs[some][lo : lo + (1 << 16)]), pair=pa.array(u.pairs[some][lo : lo + (1 << 16)]), n=pa.array(holds[some][lo : lo + (1 << 16)]))


def messages(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What the blocks of ``(doc_id, text)`` say; see ``told``. Map-only."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = held("alignment", (path_a, path_b), lambda: Aligner(path_a, path_b))
        block, size, lines, index = TaskContext.get().partitionId() << 32, 0, [], Interner()
        for batch in batches:
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = x.as_py()
                own = np.fromiter(map(index.__getitem__, aligner.split(" " + text)), dtype=np.int32) if text else _NONE
                lines.append((doc_id, own))
                size += len(text or "")
                if size >= block_bytes:
                    yield from told(aligner, block, lines, list(index))
                    block, size, lines, index = block + 1, 0, [], Interner()
        if lines:
            yield from told(aligner, block, lines, list(index))

    return docs.mapInArrow(apply, SAID)


def totals(lines: pa.Table, answers: pa.Table) -> pa.Table:
    """A block's documents with the sums of their links' counts."""
    order = np.argsort(answers["pair"].to_numpy())
    count, top = answers["count"].to_numpy()[order], answers["top"].to_numpy()[order].astype(np.int64)
    lists = lambda rows, c: rows[c].combine_chunks().flatten().to_numpy().astype(np.int64)
    kind = lines["kind"].to_numpy()
    of = lines.filter(pa.array(kind == UNITS))
    links, place = lists(of, "xs"), lists(of, "ys")
    upto = np.cumsum(links)
    per_unit = [(c := np.concatenate([[0], np.cumsum(v[place])]))[upto] - c[upto - links] for v in (count, top)]
    docs = lines.filter(pa.array(kind == LINES))
    n = docs["xs"].combine_chunks().value_lengths().to_numpy()
    own, times, ends = lists(docs, "xs"), lists(docs, "ys"), np.cumsum(n)
    per_doc = [(c := np.concatenate([[0], np.cumsum(v[own] * times)]))[ends] - c[ends - n] for v in per_unit]
    return docs.select(["doc_id", *FACTS]).append_column("n_best", pa.array(per_doc[1])).append_column("count_sum", pa.array(per_doc[0])).append_column("groups_sha256", docs["groups_sha256"])


RESULT = "doc_id long, " + ", ".join(f"{c} long" for c in FACTS) + ", n_best long, count_sum long, groups_sha256 string"


def pair_counts(said: DataFrame) -> DataFrame:
    """``(pair, count, top)``: how many documents link a pair of ids, and whether no pair of its A id
    is linked by more."""
    counts = staged(said.where(F.col("kind") == PAIRS).groupBy("pair").agg(F.sum("n").alias("count")), "align-counts")
    counts = counts.withColumn("a", F.shiftright("pair", SHIFT))
    best = counts.groupBy("a").agg(F.max("count").alias("best"))
    return counts.join(F.broadcast(best), "a").select("pair", "count", (F.col("count") == F.col("best")).alias("top"))  # at most the vocabulary of A


def align(docs: DataFrame, id: str = "doc_id", text: str = "text", *, path_a: str | None = None, path_b: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each document: its tokens of A and B, groups, links, those links whose count is the
    highest of their A id, the sum of its links' counts, and a digest of its groups.

    A text that is null or empty, or that a tokenizer does not give back byte for byte, has no
    tokens: zeros and an empty digest. Special tokens in a text are plain text. Rows of one id, null
    ids too, count each as a document. Texts of any length are read whole. An empty table gives no
    rows; other columns are not read.
    """
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    said = staged(messages(rows, path_a or default_a(), path_b or default_b(), block_bytes), "align-said")
    asks = said.where(F.col("kind") == PAIRS).select("block", "pair")
    answers = asks.join(pair_counts(said), "pair").select("block", "pair", "count", "top")
    lines = said.where(F.col("kind") != PAIRS).select(F.col("block").alias("of"), "kind", "doc_id", *FACTS, "groups_sha256", "xs", "ys")
    return lines.groupBy("of").cogroup(answers.groupBy("block")).applyInArrow(totals, RESULT)


def op11(docs: DataFrame) -> DataFrame:
    """``align`` with the two public tokenizers; edge cases are stated there."""
    bound_batches(docs.sparkSession)
    return align(docs)
