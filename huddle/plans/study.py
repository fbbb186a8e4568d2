"""Per-player side tendencies: how differently a player sets up on left and
right runs, and leaderboards of those differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huddle.functions.expressions import direction_label, relative_offset
from huddle.layout import STUDY_SLOTS, Layout
from huddle.operators.frames import regex_filter
from huddle.operators.pivot import pivot_sides, side_difference
from huddle.operators.slots import SLOT, slot_assign, with_center_offset
from huddle.operators.tendencies import leaderboard_by_feature, leaderboard_total

DIFF_FEATURES = ("dir_diff", "o_diff", "yrel_diff")


def study_rows(frames: DataFrame, layout: Layout, event_value: str | None = "ball_snap") -> DataFrame:
    """Left/right run rows with slots (every C and TE keeps its slot) and the
    offset from the play's center (center = 0; plays without a center keep
    their rows with a null offset)."""
    rows = regex_filter(frames, layout, event_value, layout.study_required)
    rows = rows.withColumn(layout.label, direction_label(layout.label_source, layout.left_tokens,
                                                         layout.right_tokens))
    if layout.x and layout.line_of_scrimmage:
        rows = rows.withColumn("x_rel_los", relative_offset(layout.x, layout.line_of_scrimmage))
    slotted = slot_assign(rows, layout, STUDY_SLOTS)
    return with_center_offset(slotted, layout, inner=False, mode="zero", center_rows=rows)


def side_tendencies(rows: DataFrame, layout: Layout) -> DataFrame:
    """Per (player, name, slot): mean heading, facing and center offset on
    left and on right runs, and their absolute differences."""
    piv = pivot_sides(rows, [layout.entity, layout.entity_name, SLOT], layout.label,
                      {"dir": layout.heading, "o": layout.facing, "yrel": "y_rel_C"})
    return side_difference(piv)


def leaderboards(diff: DataFrame, layout: Layout, n_total: int = 20, n_feature: int = 10):
    ids = [layout.entity, SLOT]
    return (leaderboard_total(diff, ids, n_total),
            leaderboard_by_feature(diff.select(layout.entity, layout.entity_name, SLOT, *DIFF_FEATURES),
                                   [layout.entity, layout.entity_name, SLOT], DIFF_FEATURES, n_feature))


def player_rows(rows: DataFrame, layout: Layout) -> DataFrame:
    """Complete per-row inputs of the per-player models."""
    ids = [c for c in (*layout.keys, *layout.tiebreak) if c != layout.entity]
    return (rows.select(*ids, layout.entity, layout.entity_name, SLOT, layout.label, layout.heading,
                        layout.facing, "y_rel_C")
            .dropna()
            .withColumn("dir_o", F.col(layout.heading) * F.col(layout.facing)))
