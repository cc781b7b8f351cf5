"""A training-data pipeline over ``documents``: each stage keeps what the next one works on.

``STAGES`` are ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame, which is written as Parquet in the shared folder and read again as the next one's
documents. All but the last return the columns of their input, whatever their names are: what a
stage adds for itself clashes with none of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bagminhash, langid, packing, repeats
from tesserae.llm.common import bound_batches, fresh_names, staged, table

#: A document is in no known language if so large a share of its words' trigrams was never seen in
#: training. It depends on neither the number of labels nor on how many languages a text mixes.
MOST_UNKNOWN = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones teach stay; those without
    letters, and those of words that are strange to all of them, go.

    Null and empty texts have no letter and go; very long ones are read whole; repeated rows and
    rows of one id are each decided alike; a null id, language or any other null stays as it is. An
    empty table, or one without a label, gives no rows. Of equal scores the first label counts,
    which decides nothing here.
    """
    bound_batches(spark)
    label, score, unknown = fresh_names(docs.columns, "_lang_pred", "_lang_score", "_lang_unknown")
    tagged = langid.identify(docs, langid.fit(docs), names=(label, score), unknown=unknown)
    return tagged.where((F.col(label) != langid.UNDETERMINED) & (F.col(unknown) <= MOST_UNKNOWN)).drop(label, score, unknown)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one of the least id.

    A null text counts as empty, and all empty texts are one class. A null id counts as a hash of
    its text. Of rows of one id the least text hash stays, of equal rows any one. Texts of any
    length are compared whole. An empty table gives no rows.
    """
    bound_batches(spark)
    return bagminhash.one_of_each(docs)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document holds are taken out of the later one; a
    document that is left empty goes, and ``n_chars``, where there is one, is counted anew.

    Null, empty and blank texts go. A null id comes after all others; rows of one id do not count
    as earlier than each other, so repeated rows both stay. Texts of any length are read whole. An
    empty table gives no rows.
    """
    bound_batches(spark)
    out = repeats.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed token sequences.

    A null or empty text is its end token alone; a null id stays null; long texts fill several
    sequences; repeated rows are packed each. An empty table gives no rows. Only the id and the text
    are read.
    """
    bound_batches(spark)
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("repeat_dedup", repeat_dedup), ("packing", pack)]

#: Learned models, hashing and tokenizers have no SQL twin; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
