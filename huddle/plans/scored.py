"""The scored fixture: rows with a known label and a fixed, data-derived
prediction, so evaluation and regression operators have exact oracles
without a trained model.  Label = side of the run; prediction = a fixed
threshold rule on the heading measure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huddle.layout import Layout

# Fixed values of the stand-in prediction rule.
THRESHOLD = 25.0


def scored_rows(frames: DataFrame, layout: Layout, threshold: float = THRESHOLD) -> DataFrame:
    return (frames.filter(F.col(layout.label).isin("left", "right"))
            .withColumn("label", F.col(layout.label))
            .withColumn("prediction", F.when(F.col(layout.heading) <= threshold, F.lit("left"))
                        .otherwise(F.lit("right"))))


# (name, threshold) pairs of the candidate rules compared by best_model.
RULES = (("rule_10", 10.0), ("rule_25", 25.0), ("rule_40", 40.0))
