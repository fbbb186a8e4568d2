"""Evaluation of (label, prediction) rows: accuracy per segment, confusion
matrix, per-class report, best-of selection (M7-M9, M14, T4).

All are aggregates over the scored rows, so they run where the predictions
are (no collect of predictions to the driver)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hit(label: str, prediction: str):
    return F.when(F.col(label) == F.col(prediction), 1.0).otherwise(0.0)


def accuracy_by_segment(df: DataFrame, segment: Sequence[str] | str | None, label: str = "label",
                        prediction: str = "prediction", min_rows: int = 0) -> DataFrame:
    """Share of rows with prediction == label, per segment (M7), with the
    segment's row count; segments under ``min_rows`` are dropped (F13)."""
    seg = [segment] if isinstance(segment, str) else list(segment or [])
    agg = df.groupBy(*seg).agg(F.count(F.lit(1)).alias("n"), F.avg(hit(label, prediction)).alias("accuracy"))
    return agg.filter(F.col("n") >= min_rows) if min_rows else agg


def rank_segments(acc: DataFrame, col: str = "accuracy", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Segments best first (T4)."""
    return acc.orderBy(F.col(col).desc(), *tiebreak)


def confusion_matrix(df: DataFrame, classes: Sequence[str], label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    """One row per true class, one count column per predicted class (M8):
    the pivot with explicit values as one conditional aggregate."""
    aggs = [F.count(F.when(F.col(prediction) == F.lit(c), F.lit(1))).alias(f"pred_{c}") for c in classes]
    return df.filter(F.col(label).isin(list(classes))).groupBy(label).agg(*aggs)


def classification_report(df: DataFrame, classes: Sequence[str], label: str = "label",
                          prediction: str = "prediction") -> DataFrame:
    """precision, recall, f1, support per class, plus ``accuracy``,
    ``macro avg`` and ``weighted avg`` rows (M9).  One global aggregate of
    per-class counts, then arithmetic on that single row."""
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(hit(label, prediction)).alias("hits")]
    for i, c in enumerate(classes):
        aggs += [
            F.count(F.when((F.col(label) == c) & (F.col(prediction) == c), 1)).alias(f"tp{i}"),
            F.count(F.when(F.col(prediction) == c, 1)).alias(f"pp{i}"),
            F.count(F.when(F.col(label) == c, 1)).alias(f"sup{i}"),
        ]
    counts = df.agg(*aggs)

    def safe_div(a, b):
        # no predicted (or no true) rows of a class: 0, as a report does
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    rows = []
    for i, c in enumerate(classes):
        p = safe_div(F.col(f"tp{i}"), F.col(f"pp{i}"))
        r = safe_div(F.col(f"tp{i}"), F.col(f"sup{i}"))
        f1 = safe_div(2 * p * r, p + r)
        rows.append(F.struct(F.lit(c).alias("class"), p.alias("precision"), r.alias("recall"),
                             f1.alias("f1"), F.col(f"sup{i}").cast("bigint").alias("support")))
    per = counts.select("n", "hits", F.explode(F.array(*rows)).alias("r")).select("n", "hits", "r.*")
    summary = per.groupBy().agg(
        F.first("n").alias("n"), F.first("hits").alias("hits"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.try_divide(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("wp"),
        F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("wr"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("wf"),
        F.sum("support").alias("sup"),
    )
    tail = summary.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.try_divide(F.col("hits"), F.col("n")).alias("f1"),
                 F.col("n").cast("bigint").alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("sup").cast("bigint").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                 F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("sup").cast("bigint").alias("support")),
    )).alias("r")).select("r.*")
    return per.drop("n", "hits").unionByName(tail)


def best_of(results: DataFrame, name: str = "family", score: str = "accuracy", order: str = "order_idx") -> DataFrame:
    """The best row by score; on equal scores the earlier one (strict ``>``
    in a loop keeps the first) (M14).  ``max_by`` is a partial aggregate."""
    key = F.struct(F.col(score), (-F.col(order)).alias("_neg_order"))
    return results.agg(F.max_by(F.struct(*[F.col(c) for c in results.columns]), key).alias("b")).select("b.*")
