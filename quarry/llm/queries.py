"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import dartminhash, decision_list, decontaminate, html_layout, importance, mixing, passages, pii, sharding, wordpiece
from quarry.llm.common import table


def op1_wfq_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op1_wfq_mixing(table(spark, sf_dir, "documents"))


def op2_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.op2_dartminhash(table(spark, sf_dir, "documents"))


def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op3_rendezvous_sharding(table(spark, sf_dir, "documents"))


def op5_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op5_positional_index(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_list.op6_decision_list(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.op4_collinear_passages(table(spark, sf_dir, "documents"))


def op7_layout_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.op7_layout_html(table(spark, sf_dir, "pages"))


def op8_longest_match_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.op8_longest_match_tokens(table(spark, sf_dir, "documents"))


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.op9_importance_resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op10_crf_pii(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_wfq_mixing,
        op2_dartminhash,
        op3_rendezvous_sharding,
        op4_collinear_passages,
        op5_positional_index,
        op6_decision_list,
        op7_layout_html,
        op8_longest_match_tokens,
        op9_importance_resampling,
        op10_crf_pii,
        pipeline,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_wfq_mixing": mixing.ORACLE, "op5_positional_index": decontaminate.ORACLE}
