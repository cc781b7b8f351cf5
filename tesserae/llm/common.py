"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.staging import shared_dir, small, staged, temporary

__all__ = ["shared_dir", "small", "staged", "temporary"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that clash with none of ``taken`` (case aside)."""
    held, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def plain(df: DataFrame) -> DataFrame:
    """The same rows with columns named ``c0, c1, ...``: what an operator adds clashes with none of
    them, and names with dots do not hinder a Python stage. ``toDF`` puts the names back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def every(df: DataFrame) -> list[Column]:
    """All columns by name, whatever characters their names hold."""
    return [F.col(f"`{c}`") for c in df.columns]


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def doc_crc(column: str = "doc_id") -> Column:
    """crc32 of the id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, limit: str = "16m") -> None:
    """Keeps the Arrow batches between Spark and Python small, so that a task's buffers stay small
    beside what several operators of one session hold. A smaller bound that the session has stays."""
    have = spark.conf.get(BATCH_BYTES, None)
    if have is None or _bytes(have) > _bytes(limit):
        spark.conf.set(BATCH_BYTES, limit)


def _bytes(size: str) -> int:
    size = size.lower().removesuffix("b")
    return int(size[:-1]) << {"k": 10, "m": 20, "g": 30, "t": 40}[size[-1]] if size[-1:] in tuple("kmgt") else int(size)


@contextmanager
def batches_of(spark: SparkSession, limit: str = "16m"):
    """``bound_batches`` for what is run inside; the setting is put back afterwards."""
    before = spark.conf.get(BATCH_BYTES, None)
    bound_batches(spark, limit)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


def parts_of(df: DataFrame, part_bytes: int) -> int:
    """How many parts of about ``part_bytes`` hold the stored tables that ``df`` reads, and at least
    as many as there are shuffle partitions: memory is bounded by bytes, not by a setting. Rows
    that are no stored table have no known size and count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(n for n in sizes if n < 1 << 60)
    return max(shuffle_partitions(df.sparkSession), -(-size // part_bytes))


HOT_SHARE = 1000


def join_hot(left: DataFrame, right: DataFrame, key: str, spread: int = 64) -> DataFrame:
    """Inner join on a key that many rows of ``left`` may share and that ``right`` holds once.

    Keys with over a ``HOT_SHARE``-th of the left rows (so at most that many keys: a proven bound)
    are dealt over ``spread`` parts, to each of which their one right row goes. Both sides are
    read twice, so they should be stored tables.
    """
    spark = left.sparkSession
    sizes = left.groupBy(key).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("t"))
    hot = [r[0] for r in sizes.crossJoin(F.broadcast(total)).where(F.col("_n") * HOT_SHARE > F.greatest(F.col("t"), F.lit(100 * HOT_SHARE))).select(key).collect()]  # one row of totals
    if not hot:
        return left.join(right, key)
    marks = F.broadcast(spark.createDataFrame([(k,) for k in hot], left.select(key).schema).withColumn("_hot", F.lit(True)))
    rest = [c for c in left.columns if c != key]
    dealt = left.join(marks, key, "left").withColumn("_part", F.when(F.col("_hot"), F.pmod(F.xxhash64(*rest) if rest else F.xxhash64(key), F.lit(spread))).otherwise(0).cast("int")).drop("_hot")
    copies = right.join(marks, key, "left").withColumn("_part", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return dealt.join(copies, [key, "_part"]).drop("_part")


def _murmur_long(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """The hash of a long that Spark partitions by (Murmur3, 32 bits)."""

    def mixed(h: np.ndarray, k: np.ndarray) -> np.ndarray:
        k = (k * np.uint64(0xCC9E2D51)) & _LOW
        k = ((k << np.uint64(15)) | (k >> np.uint64(17))) & _LOW
        h = h ^ ((k * np.uint64(0x1B873593)) & _LOW)
        h = ((h << np.uint64(13)) | (h >> np.uint64(19))) & _LOW
        return (h * np.uint64(5) + np.uint64(0xE6546B64)) & _LOW

    x = x.astype(np.uint64)
    h = mixed(mixed(np.full(len(x), seed, dtype=np.uint64), x & _LOW), x >> np.uint64(32)) ^ np.uint64(8)
    h = ((h ^ (h >> np.uint64(16))) * np.uint64(0x85EBCA6B)) & _LOW
    h = ((h ^ (h >> np.uint64(13))) * np.uint64(0xC2B2AE35)) & _LOW
    return (h ^ (h >> np.uint64(16))).astype(np.uint32).view(np.int32).astype(np.int64)


_LOW = np.uint64(0xFFFFFFFF)
MOST_PLACED = 4096


def dealt(number: Column, count: int, spark: SparkSession) -> Column:
    """A group's number below ``count`` as the long of ``placed`` that stands for it. Beyond
    ``MOST_PLACED`` groups the law of large numbers evens tasks out, and numbers stay as they are."""
    if count > MOST_PLACED:
        return number.cast("long")
    return F.get(F.array(*map(F.lit, placed(count, shuffle_partitions(spark)).tolist())), number.cast("int")).cast("long")


def placed(count: int, partitions: int) -> np.ndarray:
    """``count`` distinct longs that hash partitioning deals evenly: the i-th lies in partition
    ``i % partitions``. Groups numbered by them do not collide in one task."""
    out = np.full(count, -1, dtype=np.int64)
    filled = np.zeros(partitions, dtype=np.int64)  # how many longs each partition has been given
    want = np.bincount(np.arange(count) % partitions, minlength=partitions)
    lo, block = 0, max(4096, 4 * count)
    while (filled < want).any():
        x = np.arange(lo, lo + block, dtype=np.int64)
        at = _murmur_long(x) % partitions
        order = np.argsort(at, kind="stable")
        x, at = x[order], at[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at) + filled[at]
        fits = nth < want[at]
        out[nth[fits] * partitions + at[fits]] = x[fits]
        filled += np.bincount(at[fits], minlength=partitions)
        lo += block
    return out


class Interner(dict):
    """Maps a string to a dense number, the next free one for a new string.

    ``fresh`` holds the strings that still have no row in the caller's tables. The caller empties
    it with ``reset`` once it has grown past its bound, so memory stays bounded on any input.
    """

    def __init__(self, limit: int = 400_000) -> None:
        super().__init__()
        self.limit = limit
        self.fresh: list = []
        self.held = 0

    def __missing__(self, key):
        n = self[key] = len(self)
        self.fresh.append(key)
        return n

    def take_fresh(self) -> list:
        out, self.fresh = self.fresh, []
        self.held += sum(map(len, out))
        return out

    @property
    def full(self) -> bool:
        return len(self) > self.limit or self.held > 40 * self.limit

    def reset(self) -> None:
        self.clear()
        self.held = 0
        self.fresh = []


class Memo(dict):
    """A dict that computes absent values with ``make``; emptied by itself past ``limit``."""

    def __init__(self, make: Callable, limit: int = 300_000) -> None:
        super().__init__()
        self.make = make
        self.limit = limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


_HELD: dict = {}


def held(operator: str, key, make: Callable):
    """What an operator keeps in a Python worker from task to task. A worker that goes on to
    another operator drops what the one before has kept, so tables do not add up over stages."""
    if _HELD.get("operator") != operator:
        _HELD.clear()
        _HELD["operator"] = operator
        gc.collect()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)
    if _HELD.get("key") != key:
        _HELD.pop("value", None)
        _HELD.update(key=key, value=make())
    return _HELD["value"]
