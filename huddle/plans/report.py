"""The whole analysis in the reference's order: features at an event, models
per segment, outcome averages, regressions of outcome on predictability,
player side tendencies and leaderboards, per-player models.

Every result is a DataFrame; nothing is collected here.  The wide feature
table feeds many model fits, so it is checkpointed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huddle.layout import TRACKING, Layout
from huddle.operators.entity_models import entity_models
from huddle.operators.frames import regex_filter, substring_or_filter
from huddle.operators.joins import join_metrics
from huddle.operators.regress import ols_summary
from huddle.operators.tendencies import avg_by, avg_by_formation, avg_by_team, first_attribute, top_bottom
from huddle.plans.features import snap_features
from huddle.plans.modeling import by_role_count, by_segment, model_table
from huddle.plans.study import leaderboards, player_rows, side_tendencies, study_rows


def _acc_as(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col("segment").alias(name), "n", "accuracy")


def tendency_report(spark: SparkSession, merged: DataFrame, layout: Layout = TRACKING,
                    event_value: str | None = "ball_snap", before_event: bool = False,
                    min_segment: int = 100, min_player: int = 50, min_position: int = 10,
                    study_event: str | None = "ball_snap", one_frame: bool = False) -> dict[str, DataFrame]:
    """All report tables.  ``event_value``/``before_event`` choose the frame of
    the wide features; the player study and leaderboards always use
    ``study_event`` (the snap), whichever frame the features use (B21)."""
    out: dict[str, DataFrame] = {}
    wide = snap_features(merged, layout, event_value, before_event, one_frame)
    table = model_table(wide, layout)
    out["wide_features"] = table

    out["accuracy_by_role_count"] = by_role_count(spark, table, layout, min_segment)
    team_acc = by_segment(spark, table, layout, layout.team, min_segment)
    out["accuracy_by_team"] = team_acc
    team_yards = avg_by_team(merged, layout)
    team = join_metrics(team_yards, _acc_as(team_acc, layout.team), layout.team)
    out["team_metrics"] = team
    out["team_ols"] = ols_summary(team, "accuracy", "avg_yards")
    out["team_top_bottom"] = top_bottom(team, "accuracy", [layout.team], 3)

    form_acc = by_segment(spark, table, layout, layout.formation, min_segment)
    out["accuracy_by_formation"] = form_acc
    form_yards = avg_by_formation(substring_or_filter(merged, layout), layout)
    form = join_metrics(form_yards, _acc_as(form_acc, layout.formation), layout.formation)
    out["formation_metrics"] = form
    out["formation_ols"] = ols_summary(form, "accuracy", "avg_yards_lr")

    rows = study_rows(merged, layout, study_event)
    diff = side_tendencies(rows, layout)
    out["side_differences"] = diff
    out["leaderboard"], out["leaderboard_by_feature"] = leaderboards(diff, layout)

    pr = player_rows(rows, layout)
    ids = [c for c in (*layout.keys, *layout.tiebreak)]
    pacc = entity_models(spark, pr, layout.entity, [layout.heading, layout.facing, "y_rel_C", "dir_o"],
                         layout.label, ids, min_rows=min_player).withColumnRenamed("entity", layout.entity)
    first = first_attribute(pr, [layout.entity], [layout.entity_name, "true_position"], ids)
    # mean outcome over the player's left/right run rows at the event
    player_yards = avg_by(regex_filter(merged, layout, study_event, required=[layout.outcome]),
                          [layout.entity], layout.outcome)
    players = pacc.join(first.drop("num_samples"), layout.entity).join(player_yards, layout.entity)
    players = players.dropna(subset=["accuracy", "avg_yards"])
    out["player_metrics"] = players
    out["player_top_bottom"] = top_bottom(players, "accuracy", [layout.entity], 10)
    out["player_ols"] = ols_summary(players, "accuracy", "avg_yards")
    out["position_ols"] = ols_summary(players, "accuracy", "avg_yards", ["true_position"], min_position)
    return out
