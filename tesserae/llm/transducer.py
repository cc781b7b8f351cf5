"""SentencePiece encoding and decoding as weighted finite-state transduction.

Two transducers are compiled: the normaliser (the model's character map, white-space rules, dummy
prefix and space marks; longest rewrites first, deterministic) and the pieces with byte fallback.
Composing them with an input gives a lattice whose arcs are pieces; the tropical-semiring shortest
path is the encoding. For a unigram model an arc weighs its negative score. For a BPE
model a state also remembers the last piece, and an arc weighs 0 where merging the two pieces'
text leaves exactly the two, else infinity: a segmentation is the one that merging yields exactly
if each of its pieces and each neighbouring pair is stable in this sense, so the path of weight 0
is the BPE encoding and is unique.

No piece holds a space mark after another character, so no piece crosses the start of a run of
marks; inputs are composed run by run, and a worker remembers the paths of words it has met.

Edge cases: a null text encodes like the empty one, to no ids. Characters outside the vocabulary
become their UTF-8 bytes; ids that form no valid UTF-8 decode to replacement characters. A mark
character in the text itself decodes as a space. Repeated rows are encoded each; other columns
are ignored; texts of any length are linear work.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, fresh_names, held, plain

MARK = "▁"
UNIGRAM, BPE = 1, 2
INF = float("inf")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialised protocol buffer."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class Normalizer:
    """The normaliser of a model as a deterministic transducer over characters.

    The precompiled character map is a double array of 32-bit units, whose paths are the UTF-8
    bytes of what is rewritten, and a block of null-ended rewrites. Its paths are read out once;
    at a position the longest one applies, and any other character passes as it is.
    """

    def __init__(self, spec: dict) -> None:
        self.prefix, self.squeeze, self.marked = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.rules = _character_map(spec.get(2) or b"")
        firsts = sorted({k[0] for k in self.rules})
        self.longest = max(map(len, self.rules), default=0)
        self.starts = re.compile("[" + "".join(map(re.escape, firsts)) + "]") if firsts else None

    def _rewritten(self, text: str) -> str:
        if not self.starts or not self.starts.search(text):
            return text
        out, at, rules = [], 0, self.rules
        while m := self.starts.search(text, at):
            i = m.start()
            out.append(text[at:i])
            for n in range(min(self.longest, len(text) - i), 0, -1):
                if (to := rules.get(text[i : i + n])) is not None:
                    out.append(to)
                    at = i + n
                    break
            else:
                out.append(text[i])
                at = i + 1
        out.append(text[at:])
        return "".join(out)

    def __call__(self, text: str) -> str:
        text = self._rewritten(text)
        if self.squeeze:
            text = re.sub(" {2,}", " ", text.strip(" "))
        if not text:
            return ""
        text = (" " if self.prefix else "") + text
        return text.replace(" ", MARK) if self.marked else text


def _character_map(data: bytes) -> dict[str, str]:
    """What a precompiled character map rewrites, by whole characters."""
    if not data:
        return {}
    size = int.from_bytes(data[:4], "little")
    units, block = np.frombuffer(data[4 : 4 + size], dtype="<u4").astype(np.int64), data[4 + size :]
    offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
    labels = np.arange(1, 256)
    out: dict[str, str] = {}
    stack = [(offset(int(units[0])), b"")]
    while stack:
        at, key = stack.pop()
        to = at ^ labels
        held = to < len(units)
        held[held] = units[to[held]] & 0x800000FF == labels[held]
        for c, place in zip(labels[held].tolist(), to[held].tolist()):
            u, more = int(units[place]), key + bytes([c])
            down = place ^ offset(u)
            if u >> 8 & 1:
                begin = int(units[down]) & 0x7FFFFFFF
                out[more.decode()] = block[begin : block.index(b"\0", begin)].decode()
            stack.append((down, more))
    return out


class Transducer:
    """The compiled model; one for each Python worker."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        top = list(_fields(model.serialized_model_proto()))
        trainer = dict(_fields(next((v for k, v in top if k == 2), b"")))
        normalizer = dict(_fields(next((v for k, v in top if k == 3), b"")))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are segmentations by shortest path")
        if any(dict(_fields(v)).get(3) == 4 for k, v in top if k == 1):
            raise ValueError("a model with user-defined symbols is not supported")
        if trainer.get(24):
            raise ValueError("a model that takes white space as a suffix is not supported")
        self.normalize = Normalizer(normalizer)
        self.prefix = self.normalize.prefix
        n = len(model)
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids))
        self.unknown = model.unk_id()
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = all(i != self.unknown for i in self.bytes)
        self.surface = [b""] * n
        for piece, i in self.ids.items():
            self.surface[i] = piece.replace(MARK, " ").encode()
        if self.unknown >= 0:
            self.surface[self.unknown] = trainer.get(44, " \u2047 ".encode())
        for b, i in enumerate(self.bytes):
            if i != self.unknown:
                self.surface[i] = bytes([b])
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses the start of a word; words cannot be composed one by one")
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
        self.runs = re.compile(f"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.halves = Memo(self._halves, 100_000)
        self.ordered = Memo(self._ordered, 100_000)
        self.stable = Memo(self._is_stable, 500_000)
        self.known = Memo(self._path, 600_000)

    def _merge(self, text: str, least: int = 1) -> list[str]:
        """Merges by score, leftmost first among equals, down to ``least`` parts."""
        parts = list(text)
        score = self.score.get
        while len(parts) > least:
            best, at = -INF, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes this one; None if merging its text never makes it."""
        parts = self._merge(piece, 2)
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _ordered(self, piece: str) -> bool:
        """Whether each part of a piece is made before the piece: then merges run by score alone."""
        s = self.score[piece]
        return all(len(h) == 1 or (self.score.get(h, -INF) > s and self.halves[h] and self.ordered[h]) for h in self.halves[piece])

    def _is_stable(self, pair: tuple[str, str]) -> bool:
        """Whether merging the text of the pair leaves exactly the pair.

        The pieces next to the border grow along the right edge of the first piece and the left
        edge of the second. The pair falls if, at some point, merging over the border has a higher
        score than the next merge on either side (leftmost first among equals).
        """
        left, right = pair
        for p in pair:
            if len(p) > 1 and not self.halves[p]:
                return False
        if not left:
            return True
        if left.count(MARK) + right.count(MARK) > 1 or any(len(p) > 1 and not self.ordered[p] for p in pair):
            return self._merge(left + right) == [left, right]
        score, halves = self.score, self.halves
        a, b = [left], [right]
        while len(a[-1]) > 1:
            a.append(halves[a[-1]][1])
        while len(b[-1]) > 1:
            b.append(halves[b[-1]][0])
        i, j = len(a) - 1, len(b) - 1
        while True:
            up = score[a[i - 1]] if i else -INF
            down = score[b[j - 1]] if j else -INF
            over = score.get(a[i] + b[j])
            if over is not None and over > up and over >= down:
                return False
            if i and up >= down:
                i -= 1
            elif j:
                j -= 1
            else:
                return True

    def _arcs(self, text: str, at: int) -> list[str]:
        """Pieces that start at a position; a lone character is always one, by byte fallback."""
        ids = self.ids
        top = min(len(text), at + self.longest)
        return [text[at : at + 1], *(p for end in range(at + 2, top + 1) if (p := text[at:end]) in ids)]

    def _path(self, text: str) -> bytes:
        return array("I", self._spell(self._shortest(text))).tobytes()

    def _shortest(self, text: str) -> list[str]:
        if self.kind == UNIGRAM:
            low = min(self.score.values(), default=0.0) - 10.0
            cost, back = [0.0] + [INF] * len(text), [0] * (len(text) + 1)
            for i in range(len(text)):
                for p in self._arcs(text, i):
                    c = cost[i] - self.score.get(p, low)
                    if c < cost[i + len(p)]:
                        cost[i + len(p)], back[i + len(p)] = c, i
            out, j = [], len(text)
            while j:
                out.append(text[back[j] : j])
                j = back[j]
            return out[::-1]
        return self._shortest_bpe(text)

    def _shortest_bpe(self, text: str) -> list[str]:
        """The path of weight 0. Arcs are followed longest first. A prefix has one path of weight
        0 at most, so a position from which the end was not reached need not be reached again."""
        n, ids, stable, longest = len(text), self.ids, self.stable, self.longest
        out: list[str] = []
        tried: list[int] = []
        dead: set[int] = set()
        at, size = 0, min(longest, n)
        while at < n:
            last = out[-1] if out else ""
            while size:
                end = at + size
                if end not in dead:
                    p = text[at:end]
                    if (size == 1 or p in ids) and stable[last, p]:
                        break
                size -= 1
            if size:
                out.append(p)
                tried.append(size)
                at = end
                size = min(longest, n - at)
            else:
                dead.add(at)
                out.pop()
                size = tried.pop()
                at -= size
                size -= 1
        return out

    def _spell(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.fallback:
                out += [self.bytes[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return out

    def encode(self, text: str) -> np.ndarray:
        known = self.known
        out = [known[u] if len(u) < 64 else self._path(u) for u in self.runs.findall(self.normalize(text))]
        ids = np.frombuffer(b"".join(out), dtype="<u4")
        if not self.fallback and len(ids):  # neighbouring unknown characters are one unknown piece
            odd = ids == self.unknown
            ids = ids[~(odd & np.concatenate([[False], odd[:-1]]))]
        return ids

    def decode(self, ids) -> str:
        surface = self.surface
        text = b"".join([surface[i] for i in ids]).decode("utf-8", "replace")
        if self.normalize.squeeze:
            return text.lstrip(" ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def compiled(path: str) -> Transducer:
    return held("transducer", path, lambda: Transducer(path))


def encode(docs: DataFrame, text: str = "text", keep: list[str] | None = None, *, model: str | None = None) -> DataFrame:
    """Adds ``ids array<int>`` to the columns ``keep`` (all but the text by default); map-only."""
    path = model or default_model()
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    source = plain(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`")))
    schema = source.drop(source.columns[-1]).withColumn("ids", F.array().cast("array<int>")).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                rows = [machine.encode(x.as_py() or "").astype(np.int32) for x in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(rows, pa.list_(pa.int32()))], names=schema.names)

    return source.mapInArrow(apply, schema).toDF(*keep, *fresh_names(list(keep), "ids"))


def decode(encoded: DataFrame, ids: str = "ids", keep: list[str] | None = None, *, model: str | None = None) -> DataFrame:
    """Adds ``text``, decoded from ``ids``, to the columns ``keep`` (all but the ids by default)."""
    path = model or default_model()
    keep = [c for c in encoded.columns if c != ids] if keep is None else keep
    source = plain(encoded.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`")))
    schema = source.drop(source.columns[-1]).withColumn("text", F.lit("")).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(path)
        for batch in batches:
            rows = [machine.decode(x.as_py() or ()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(rows, pa.string())], names=schema.names)

    return source.mapInArrow(apply, schema).toDF(*keep, *fresh_names(list(keep), "text"))


def op9(docs: DataFrame, *, model: str | None = None) -> DataFrame:
    """Digests of each whole text's encoding and of what decoding it gives back, made in one pass."""
    path = model or default_model()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(path)
        for batch in batches:
            rows = []
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = x.as_py() or ""
                ids = machine.encode(text)
                back = machine.decode(ids.tolist())
                rows.append((doc_id, len(ids), zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest(), back == text.replace(MARK, " ")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
