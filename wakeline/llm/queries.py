"""Queries pN_ of the problems tagged llm, over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wakeline.llm import encoding, leakage, splits, subjects
from wakeline.session import load


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.found_leaks(load(spark, sf_dir, "run_data_split"), load(spark, sf_dir, "vessel_identity"))


def p7_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = splits.connected_components(splits.identity_edges(load(spark, sf_dir, "vessel_identity")))
    rows = load(spark, sf_dir, "run_trajectories").select("traj_id", "mmsi")
    return splits.assign_splits(rows, roots, shares={"train": 0.8, "validation": 0.1, "test": 0.1}).select("traj_id", "mmsi", "vessel", "split")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_corpus(load(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.found_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.document_subjects(load(spark, sf_dir, "documents"), load(spark, sf_dir, "doc_subject_labels")).select("doc_id", "subject").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p7_found, p7_splits, p8_ids, p9_found, p10_found)}
ORACLE: dict[str, str] = {}
