"""SpotSigs document fingerprints.

A signature is an anchor (a common word) and the chain of the next ``CHAIN_WORDS`` content words
after it; a text's fingerprint is its set of signatures, so what carries no running prose weighs
little. A fingerprint is written as ``<set length>:<sorted 32-bit signature hashes in hex>``, the
whole set, so that its likeness is the exact Jaccard coefficient of the sets.

``spotsigs_matches`` compares a table's fingerprints: they are partitioned by set length, and a
pair meets only on one of the rarest signatures of each (prefix filter) in length ranges that
the threshold allows; verification stops at the length bound. ``spotsigs_members`` names the
representative of every document, so that pairs between representatives lose no link.

Edge cases: a null text counts as empty and has the empty set; a text without an anchored chain
falls back on its word pairs, then on its single word, then on its raw characters. Two empty sets
have likeness 1, an empty and a filled one 0. Repeated rows give repeated rows. A null id sorts
last in descending order; rows with equal ids follow a hash of their text. An only document is
its own next one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Interner, fresh_names, held, join_hot, plain, shuffle_partitions, staged

CHAIN_WORDS = 2
#: Common function words that serve as anchors.
ANCHORS = frozenset(
    """
    a an and are as at be been but by for from had has have he her his i if in into is it its not of on or
    she that the their there they this to was we were which will with would you your
    als am an auf aus bei das dass dem den der des die durch ein eine einen er es für hat ich im in ist mit
    nach nicht noch oder sein sich sie sind so über um und von vor war wie wird zu zum zur
    au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas
    plus pour qui que sa se ses son sont sur un une vous
    al como con del desde el ella en entre era es esta este ha hay la las lo los más me mi muy no nos o para
    pero por que se sin sobre su sus también te una uno y ya
    """.split()
)


class Spotter:
    """Signature sets of texts; one for each Python worker, with a bounded word table."""

    def __init__(self) -> None:
        self.words = Interner(150_000)
        self.hash = np.zeros(1 << 14, dtype=np.uint64)
        self.kind = np.zeros(1 << 14, dtype=np.int8)  # 0 no word, 1 content, 2 anchor

    def _learn(self) -> None:
        fresh = self.words.take_fresh()
        if not fresh:
            return
        need, first = len(self.words), len(self.words) - len(fresh)
        while len(self.kind) < need:
            self.hash, self.kind = np.concatenate([self.hash, np.zeros_like(self.hash)]), np.concatenate([self.kind, np.zeros_like(self.kind)])
        cores = [w if w.isalnum() else "".join(filter(str.isalnum, w)) for w in fresh]
        cores = [c.lower() for c in cores]
        self.hash[first:need] = [zlib.crc32(c.encode()) for c in cores]
        self.kind[first:need] = [(2 if c in ANCHORS else 1) if c else 0 for c in cores]

    def signatures(self, text: str) -> np.ndarray:
        """Sorted distinct 32-bit signature hashes of a text."""
        if self.words.full:
            self.words.reset()
        rows = np.fromiter(map(self.words.__getitem__, text.split()), dtype=np.int64)
        self._learn()
        kind = self.kind[rows]
        rows = rows[kind > 0]
        kind = kind[kind > 0]
        h = self.hash[rows]
        content = np.flatnonzero(kind == 1)
        anchors = np.flatnonzero(kind == 2)
        at = np.searchsorted(content, anchors)
        fits = at + CHAIN_WORDS <= len(content)
        anchors, at = anchors[fits], at[fits]
        if len(at):
            mixed = _mix(h[anchors])
            for k in range(CHAIN_WORDS):
                mixed = _mix(mixed ^ h[content[at + k]])
        elif len(h) > 1:
            mixed = _mix(_mix(h[:-1]) ^ h[1:])
        elif len(h):
            mixed = _mix(h)
        elif text:
            mixed = _mix(np.array([zlib.crc32(text.encode())], dtype=np.uint64))
        else:
            return np.zeros(0, dtype=np.uint32)
        return np.unique((mixed >> np.uint64(32)).astype(np.uint32))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0x94D049BB133111EB)


def write_fingerprint(signatures: np.ndarray) -> str:
    return f"{len(signatures)}:{signatures.astype('>u4').tobytes().hex()}"


def read_fingerprint(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint.partition(":")[2]), dtype=">u4").astype(np.uint32)


def pruned_jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard coefficient of two sorted sets, or 0 where their lengths alone keep it under ``least``."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(a) + len(b) - common)


def _spotter() -> Spotter:
    return held("spotsigs", 0, Spotter)


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``fingerprint`` (``fingerprint_`` where that name is taken) to the columns ``keep``, all by
    default; map-only."""
    keep = docs.columns if keep is None else keep
    source = plain(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`")))
    last = source.columns[-1]
    schema = source.drop(last).withColumn("fingerprint", F.lit("")).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = _spotter()
        for batch in batches:
            out = [write_fingerprint(spots.signatures(x.as_py() or "")) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.string())], names=[*batch.schema.names[: len(keep)], "fingerprint"])

    return source.mapInArrow(apply, schema).toDF(*keep, *fresh_names(list(keep), "fingerprint"))


def spotsigs_members(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(id, rep)`` per row: the least id of those with an equal fingerprint, the representative
    that ``spotsigs_matches`` pairs. Texts of the empty set, which it pairs with none, are one class
    as well. The least id is found by a partial aggregate, so a large class costs one row a task, and
    rows meet theirs in ``join_hot``."""
    prints = fingerprints(docs.select(key, text), text, [key]).toDF("id", "fingerprint")
    prints = staged(prints.select("id", F.sha2("fingerprint", 256).alias("class")), "spotsigs")
    reps = prints.groupBy("class").agg(F.min("id").alias("rep"))
    return join_hot(prints, reps, "class").select("id", "rep")


def spotsigs_matches(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """Pairs ``(id_a, id_b, jaccard)`` between representatives of equal fingerprints, at or over
    ``threshold``. Equal fingerprints collapse to their least id first, so groups of copies never
    multiply into pairs."""
    prints = fingerprints(docs.select(key, text), text, [key]).withColumnRenamed(key, "id")
    reps = prints.groupBy("fingerprint").agg(F.min("id").alias("id")).where(~F.col("fingerprint").startswith("0:"))
    body = F.substring_index("fingerprint", ":", -1)
    size = F.substring_index("fingerprint", ":", 1).cast("int")
    sigs = reps.select("id", size.alias("size"), F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit("(.{8})"), F.lit(1)))).alias("sig"))
    common = sigs.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = sigs.join(common, "sig").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("df", "sig")))
    head = ranked.where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * threshold) + 1)
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(1 / threshold)))
    head = head.where(F.col("df") > 1).select("id", "size", "sig", band.alias("band"))
    other = head.select(F.col("id").alias("id_b"), F.col("size").alias("size_b"), "sig", F.explode(F.array(F.col("band"), F.col("band") - 1, F.col("band") + 1)).alias("band"))
    fits = (F.least("size", "size_b") >= F.greatest("size", "size_b") * threshold) & (F.col("id") < F.col("id_b"))
    pairs = head.join(other, ["band", "sig"]).where(fits).select(F.col("id").alias("id_a"), "id_b").distinct()

    @F.pandas_udf("double")
    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([pruned_jaccard(read_fingerprint(x), read_fingerprint(y), threshold) for x, y in zip(a, b)])

    left, right = reps.select(F.col("id").alias("id_a"), F.col("fingerprint").alias("fa")), reps.select(F.col("id").alias("id_b"), F.col("fingerprint").alias("fb"))
    found = pairs.join(left, "id_a").join(right, "id_b").withColumn("jaccard", likeness("fa", "fb"))
    return found.where(F.col("jaccard") >= threshold).select("id_a", "id_b", "jaccard")


def with_next(docs: DataFrame, apply, schema: str) -> DataFrame:
    """Runs ``apply(rows)`` over ``(doc_id, text, next_text)`` triples, where the next document
    follows in descending id (after the last: the first).

    One shuffle of the texts by id ranges whose bounds are ids of the table; each range also gets
    the document at the head of the one below it, and the lowest range gets the first document.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    ranges = 4 * shuffle_partitions(spark)
    cuts = [i / ranges for i in range(1, ranges)]
    ends = base.agg(F.percentile_approx("doc_id", cuts, max(10_000, 50 * ranges)).alias("cuts"), F.max("doc_id").alias("top")).first()
    top = ends["top"]
    bounds = np.unique(np.array([c for c in ends["cuts"] or [] if c != top], dtype=np.int64))

    @F.pandas_udf("long")
    def place(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        value = ids.fillna(0).astype("int64").to_numpy()
        group = np.where(known, np.searchsorted(bounds, value, side="left"), 0)
        head = known & np.isin(value, bounds)
        return pd.Series(group * 2 + head)

    code = place("doc_id")
    group = F.floor(F.col("_code") / 2)
    spot = lambda pid, role: F.struct(pid.cast("long").alias("pid"), F.lit(role).alias("role"))
    own = F.array(spot(group, 0))
    more = F.when(F.col("_code") % 2 == 1, F.array(spot(group + 1, 1))).otherwise(F.array().cast("array<struct<pid:bigint,role:int>>"))
    first = F.col("doc_id").eqNullSafe(F.lit(top).cast("long"))
    wrap = F.when(first, F.array(spot(F.lit(0), 2))).otherwise(F.array().cast("array<struct<pid:bigint,role:int>>"))
    placed = base.withColumn("_code", code).select("doc_id", "text", F.explode(F.concat(own, more, wrap)).alias("at"))
    placed = placed.select("at.pid", "at.role", "doc_id", "text").repartition(shuffle_partitions(spark), "pid")
    placed = placed.sortWithinPartitions("pid", "role", F.desc_nulls_last("doc_id"), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waits: list = []  # the document that waits for its next one

        def triples():
            for batch in batches:
                for pid, role, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                    text = text.as_py()
                    if waits and waits[0] == pid:
                        yield waits[1], waits[2], text
                    waits[:] = [pid, doc_id, text] if role == 0 else []

        yield from apply(triples())

    return placed.mapInArrow(run, schema)


def op4(docs: DataFrame) -> DataFrame:
    """The contract's rows: fingerprints of each text and of its edited text, and their likeness."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def apply(triples) -> Iterator[pa.RecordBatch]:
        spots, rows, amount = _spotter(), [], 0
        kept: tuple[str, np.ndarray] = ("", spots.signatures(""))
        for doc_id, text, following in triples:
            n = len(text)
            edited = text[: n - n // 3] + following[: n // 3]
            own = kept[1] if kept[0] == text else spots.signatures(text)
            other = spots.signatures(edited)
            after = spots.signatures(following)
            kept = (following, after)
            rows.append((doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), write_fingerprint(own), write_fingerprint(other), pruned_jaccard(own, other), pruned_jaccard(own, after)))
            amount += len(rows[-1][3]) + len(rows[-1][4])
            if amount > 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                rows, amount = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return with_next(docs, apply, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
