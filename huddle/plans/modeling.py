"""Model plans over the wide feature rows: per-segment forests, the family
comparison, random search, per-player models and feature importances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huddle.layout import FULL_SLOTS, Layout, Slot
from huddle.operators.models import (
    XGB_ROUNDS, assembler, boosted_grid_search, forest_importances, grid_search, random_search, segment_forests,
    segment_models, tuned_forest,
)
from huddle.operators.pivot import interaction_features
from huddle.plans.features import feature_columns, keep_label_sides
from huddle.session import cut_lineage


def model_table(wide: DataFrame, layout: Layout, slots: Sequence[Slot] = FULL_SLOTS) -> DataFrame:
    """Wide rows with interactions, only left/right labels, lineage cut: many
    fits read this table, so it is checkpointed once into the shared
    checkpoint folder instead of recomputing the joins per fit."""
    return cut_lineage(keep_label_sides(interaction_features(wide, slots), layout), "model_table")


def by_role_count(spark: SparkSession, table: DataFrame, layout: Layout, min_rows: int = 100,
                  counts=(1, 2)) -> DataFrame:
    """One forest per TE count; the count itself is not a feature."""
    feats = feature_columns(table, layout, drop=("num_TEs",))
    return segment_models(table, "num_TEs", feats, layout.label, layout.keys, min_rows, list(counts))


def by_segment(spark: SparkSession, table: DataFrame, layout: Layout, segment: str, min_rows: int = 100) -> DataFrame:
    """One forest per team or formation; the TE count stays a feature."""
    feats = feature_columns(table, layout)
    return segment_models(table, segment, feats, layout.label, layout.keys, min_rows)


def segment_reports(table: DataFrame, layout: Layout, segment: str, min_rows: int = 100, top: int = 10,
                    spec=None) -> tuple[DataFrame, DataFrame]:
    """Of every fitted segment (M8, M10): its confusion matrix, one row per
    true label, and its ``top`` features by importance; both from the one
    registry that the fitting job wrote."""
    feats = feature_columns(table, layout)
    _, forests = segment_forests(table, segment, feats, layout.label, layout.keys, min_rows,
                                 **({"spec": spec} if spec else {}))
    names = F.when(F.col("y") == 1, "right").otherwise("left")
    matrix = forests.confusion().select(F.col("model").alias("segment"), names.alias("label"),
                                        F.col("pred_0").alias("pred_left"), F.col("pred_1").alias("pred_right"))
    rank = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("importance"), "feature"))
    best = forests.importances().withColumn("rank", rank).filter(F.col("rank") <= top)
    return matrix, best.select(F.col("model").alias("segment"), "rank", "feature", "importance")


def compare_families(spark: SparkSession, table: DataFrame, layout: Layout, families) -> DataFrame:
    feats = feature_columns(table, layout, drop=("num_TEs",))
    return grid_search(spark, table, feats, layout.label, layout.keys, families)


def tune_forest(spark: SparkSession, table: DataFrame, layout: Layout, trials: int = 50) -> DataFrame:
    feats = feature_columns(table, layout, drop=("num_TEs",))
    return random_search(spark, table, feats, layout.label, layout.keys, trials)


def compare_boosted(spark: SparkSession, table: DataFrame, layout: Layout, rounds: Sequence[int] = XGB_ROUNDS) -> DataFrame:
    """The second-order boosted family over its grid."""
    feats = feature_columns(table, layout, drop=("num_TEs",))
    return boosted_grid_search(spark, table, feats, layout.label, layout.keys, rounds=rounds)


def tune_by_model(spark: SparkSession, table: DataFrame, layout: Layout, trials: int = 50, per_round: int = 10,
                  space: dict | None = None) -> DataFrame:
    """The forest tuned by a model-based sampler."""
    feats = feature_columns(table, layout, drop=("num_TEs",))
    return tuned_forest(spark, table, feats, layout.label, layout.keys, trials, per_round, space=space)


def tuning_flow(spark: SparkSession, table: DataFrame, layout: Layout, families=("RandomForest", "GradientBoosting", "LogReg"),
                trials: int = 50, boosted: bool = True) -> DataFrame:
    """The whole flow on one table: every family's best grid point and the
    tuned forest, with the accuracy on the held-out side; ``chosen`` marks the
    one that was better on the training side (cross-validated or validation
    accuracy; ties to the earlier)."""
    cols = ["family", "order_idx", "score", "accuracy"]
    out = compare_families(spark, table, layout, list(families)).select("family", "order_idx", F.col("cv_accuracy").alias("score"), "accuracy")
    if boosted:
        grid = compare_boosted(spark, table, layout).filter("best")
        out = out.unionByName(grid.select(F.lit("XGBoost").alias("family"), F.lit(len(families)).alias("order_idx"),
                                          F.col("cv_accuracy").alias("score"), "accuracy"))
    tuned = tune_by_model(spark, table, layout, trials).filter("best")
    out = out.unionByName(tuned.select(F.lit("RandomForest (tuned)").alias("family"), F.lit(len(families) + 1).alias("order_idx"),
                                       F.col("val_accuracy").alias("score"), F.col("test_accuracy").alias("accuracy")))
    out = cut_lineage(out.select(*cols), "tuning-flow")
    best = out.orderBy(F.desc_nulls_last("score"), "order_idx").first()["order_idx"]
    return out.select(*cols, (F.col("order_idx") == F.lit(best)).alias("chosen"))


def importances(spark: SparkSession, table: DataFrame, layout: Layout, top: int = 10) -> DataFrame:
    feats = feature_columns(table, layout, drop=("num_TEs",))
    found = forest_importances(table, feats, layout.label, layout.keys)
    return found.orderBy(F.col("importance").desc(), "feature").limit(top)


def assembled(table: DataFrame, layout: Layout) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    feats = feature_columns(table, layout, drop=("num_TEs",))
    out = assembler(feats).transform(table)
    return out.select(*layout.keys, layout.label, vector_to_array(F.col("features")).alias("features"))


__all__ = ["model_table", "by_role_count", "by_segment", "segment_reports", "compare_families", "compare_boosted",
           "tune_forest", "tune_by_model", "tuning_flow", "importances", "assembled"]
