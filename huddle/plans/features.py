"""Feature plans: event-frame rows -> slots -> one wide row per play.

Three presets mirror the reference's feature scripts: at the snap event, at
the line-set event, and at the frame before the snap; ``line_only`` is the
five-slot variant without the TE and without play attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huddle.functions.expressions import direction_label, relative_offset
from huddle.layout import FULL_SLOTS, LINE_SLOTS, Layout
from huddle.operators.frames import event_frame_filter, frame_before_event
from huddle.operators.pivot import wide_features


def event_rows(frames: DataFrame, layout: Layout, event_value: str | None = "ball_snap",
               before_event: bool = False, one_frame: bool = False) -> DataFrame:
    """Run-play rows of the line roles at the event frame (or the frame before
    it), with x relative to the line and the side label attached.

    ``one_frame``: when the tag is on several frames of a play, keep only the
    last tagged frame (B10; otherwise every tagged frame's rows are kept, as
    a plain event filter does)."""
    src = frames
    if before_event:
        src = frame_before_event(frames, layout.keys, layout.frame, layout.event, event_value)
        event_value = None
    elif one_frame and event_value is not None:
        src = frame_before_event(frames, layout.keys, layout.frame, layout.event, event_value, offset=0)
    rows = event_frame_filter(src, layout, event_value)
    if layout.x and layout.line_of_scrimmage:
        rows = rows.withColumn("x_rel_los", relative_offset(layout.x, layout.line_of_scrimmage))
    return rows.withColumn(layout.label, direction_label(layout.label_source, layout.left_tokens,
                                                         layout.right_tokens))


def snap_features(frames: DataFrame, layout: Layout, event_value: str | None = "ball_snap",
                  before_event: bool = False, one_frame: bool = False) -> DataFrame:
    """Six slots, label, team, formation, TE count (the flagship table)."""
    rows = event_rows(frames, layout, event_value, before_event, one_frame)
    return wide_features(rows, layout, FULL_SLOTS)


def line_only_features(frames: DataFrame, layout: Layout, event_value: str | None = "ball_snap") -> DataFrame:
    """Five line slots, keys and label only (the tuning preset, B24)."""
    rows = event_rows(frames, layout, event_value)
    return wide_features(rows, layout, LINE_SLOTS, attributes=[layout.label], count_role=None)


def feature_columns(wide: DataFrame, layout: Layout, drop: tuple[str, ...] = ()) -> list[str]:
    """Model inputs: every column but keys, label, attributes and ``drop``."""
    skip = set(layout.keys) | {layout.label, layout.team, layout.formation} | set(drop)
    return [c for c in wide.columns if c not in skip]


def keep_label_sides(wide: DataFrame, layout: Layout) -> DataFrame:
    return wide.filter(F.col(layout.label).isin("left", "right"))
