"""The registered queries of the training-data operators: thin wrappers with production
parameters over whole tables, and SQL twins where DuckDB can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bagminhash, bloomlm, compaction, interleave, langid, lloyd, packing, radix, repeats, spotsigs, transducer, wrappers
from .common import table


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.op1(table(spark, sf_dir, "documents"))


def op2_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloomlm.op2(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op10(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op3(table(spark, sf_dir, "documents"))


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.op4(table(spark, sf_dir, "documents"))


def op5_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.op5(table(spark, sf_dir, "pages"))


def op6_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave.op6(table(spark, sf_dir, "documents"))


def op8_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.op8(table(spark, sf_dir, "documents"))


def op9_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.op9(table(spark, sf_dir, "documents"))


def op7_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.op7(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.op11(table(spark, sf_dir, "documents"))


def op12_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix.op12(table(spark, sf_dir, "documents"))


def op13_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.op13(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_repeats": op1_repeats,
    "op2_bloom_lm": op2_bloom_lm,
    "op3_packing": op3_packing,
    "op4_spotsigs": op4_spotsigs,
    "op5_wrapper_induction": op5_wrapper_induction,
    "op6_interleave": op6_interleave,
    "op7_bagminhash": op7_bagminhash,
    "op8_compaction": op8_compaction,
    "op9_transducer": op9_transducer,
    "op10_language_id": op10_language_id,
    "op11_alignment": op11_alignment,
    "op12_radix_dedup": op12_radix_dedup,
    "op13_lloyd": op13_lloyd,
}

ORACLES: dict[str, str] = {"op8_compaction": compaction.OP8_SQL, "op12_radix_dedup": radix.OP12_SQL, "op13_lloyd": lloyd.OP13_SQL}
