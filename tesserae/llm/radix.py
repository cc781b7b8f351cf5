"""Exact deduplication by distributed MSD radix partitioning.

A text is compared as its length and then its bytes. Rows of one length start as a group; each round
splits every group by the next bytes of its texts: rows are partitioned by ``(group, digit)``, and
rows of equal digits are a group of the next round. A row whose text has ended, or that is alone in
its group, is done and leaves; the rest of a text moves on without the bytes that have been
compared. Equality is decided by the bytes themselves, no digest.

Digits grow from round to round (``FIRST`` bytes, then ``GROW`` times as many), so the number of
rounds is the logarithm of the longest text that occurs twice, and a digit is never longer than its
text. A group that holds a large share of all rows is never in one task: groups are counted with
map-side combining, and rows find their group by a join whose skewed partitions adaptive execution
splits (the side of the groups has each key once).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain, staged

FIRST, GROW = 32, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """What is compared: A-Z in lower case, null as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def body(text: str) -> Column:
    return normalised(F.col(f"`{text}`")).cast("binary")


def split(alive: DataFrame, width: int, *facts: Column) -> DataFrame:
    """One round over ``(part, rest)`` and other columns: adds the number ``next`` of a row's new
    group, null for a row that is alone, and the group's ``facts``; takes the digit off ``rest``."""
    cut = alive.withColumn("digit", F.substring("rest", 1, width))
    groups = cut.groupBy("part", "digit").agg(F.count("*").alias("size"), *facts).where("size > 1")
    groups = staged(groups.withColumn("next", F.monotonically_increasing_id()), "radix-groups")
    found = cut.join(groups.hint("merge"), ["part", "digit"], "left")  # as many groups as the input has, so never broadcast
    left = F.when(F.col("next").isNotNull(), F.substring(F.col("rest"), F.lit(width + 1), F.octet_length("rest")))
    return found.withColumn("rest", left).drop("part", "digit")


def classes(texts: DataFrame, first: int = FIRST, grow: int = GROW) -> DataFrame:
    """Adds ``keep_id, group_size, kept`` to each row of ``(id, rest)``, where ``rest``, which goes,
    is a text as bytes; other columns stay.

    Of equal texts the largest id stays; of rows of that id one does. A null id is less than any
    other. An empty table gives no rows.
    """
    own = [c for c in texts.columns if c != "rest"]
    met = split(texts.withColumn("part", F.octet_length("rest").cast("long")), first)
    met = staged(met.withColumn("row", F.monotonically_increasing_id()), "radix")
    one, long = F.lit(1).cast("long"), F.col("next").isNotNull()
    out = met.where(~long).select(*own, F.col("id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"))
    alive, width = met.where(long).select(*own, "row", F.col("next").alias("part"), "rest"), first * grow
    while not alive.isEmpty():
        met = split(alive, width, F.max(F.struct("id", "row")).alias("keep"))
        met = staged(met.withColumn("more", F.coalesce(F.octet_length("rest") > 0, F.lit(False))), "radix")
        alone = F.col("next").isNull()
        facts = F.when(alone, F.col("id")).otherwise(F.col("keep.id")), F.coalesce("size", one), alone | (F.col("keep.row") == F.col("row"))
        out = out.union(met.where("not more").select(*own, *[f.alias(c) for f, c in zip(facts, ("keep_id", "group_size", "kept"))]))
        alive, width = met.where("more").select(*own, "row", F.col("next").alias("part"), "rest"), width * grow
    return out


def deduplicated(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns as they were: of texts that are equal but for the
    case of A-Z, the row of the largest id, and of several such rows any one.

    A null text counts as empty, and all empty texts are equal. A null id is less than any other.
    Texts of any length are compared whole. Extra columns may have any name.
    """
    held, own = plain(docs), dict(zip(docs.columns, plain(docs).columns))
    found = classes(held.withColumn("id", F.col(own[id])).withColumn("rest", body(own[text])))
    return found.where("kept").select(*held.columns).toDF(*docs.columns)


def op12(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row, dropped ones too.

    Edge cases are those of ``deduplicated``: a null text has the digest of the empty one; rows of
    one id and one text are two members of their group, of which one is kept; an empty table gives
    no rows; extra columns are not read.
    """
    texts = docs.select(F.col(f"`{id}`").cast("long").alias("id"), body(text).alias("rest")).withColumn("text_sha256", F.sha2("rest", 256))
    return classes(texts).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


#: DuckDB twin of op12.
OP12_SQL = f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS body FROM documents) WINDOW g AS (PARTITION BY body)
"""
