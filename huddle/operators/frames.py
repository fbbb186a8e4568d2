"""Frame selection: event-frame filters (F1-F7, F10-F11) and the frame
before an event (J7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huddle.functions.expressions import is_run
from huddle.layout import Layout
from huddle.session import bounded_broadcast


def _all(conds: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


def not_null(cols: Sequence[str]) -> Column:
    return _all([F.col(c).isNotNull() for c in cols])


def event_frame_filter(df: DataFrame, layout: Layout, event_value: str | None = "ball_snap",
                       roles: Sequence[str] | None = None, extra_required: Sequence[str] = (),
                       run_only: bool = True) -> DataFrame:
    """Rows of run plays at an event frame, in the given roles, with every
    required measure present (F1, F2; F3 with ``event_value=None``).

    All parts are plain comparisons and null tests, so Catalyst pushes them
    into the Parquet scan (``PushedFilters``)."""
    conds = []
    if run_only:
        conds.append(is_run(layout.pass_col, layout.label_source))
    if event_value is not None and layout.event is not None:
        conds.append(F.col(layout.event) == F.lit(event_value))
    conds.append(F.col(layout.role).isin(list(roles or layout.roles)))
    conds.append(F.col(layout.label_source).isNotNull())
    conds += [F.col(c).isNotNull() for c in tuple(layout.required) + tuple(extra_required)]
    return df.filter(_all(conds))


def regex_filter(df: DataFrame, layout: Layout, event_value: str | None = "ball_snap",
                 required: Sequence[str] | None = None) -> DataFrame:
    """Run plays whose label text matches the side pattern (F4), at the
    event, in the line roles, with the listed measures present."""
    conds = [is_run(layout.pass_col, layout.label_source),
             F.col(layout.label_source).rlike(layout.label_regex),
             F.col(layout.role).isin(list(layout.roles))]
    if event_value is not None and layout.event is not None:
        conds.append(F.col(layout.event) == F.lit(event_value))
    conds += [F.col(c).isNotNull() for c in (layout.required if required is None else required)]
    return df.filter(_all(conds))


def substring_or_filter(df: DataFrame, layout: Layout, extra_required: Sequence[str] = ()) -> DataFrame:
    """Run plays whose label text contains a left or a right token, with
    outcome and formation present (F6)."""
    side = None
    for t in layout.left_tokens + layout.right_tokens:
        e = F.col(layout.label_source).contains(t)
        side = e if side is None else (side | e)
    conds = [is_run(layout.pass_col, layout.label_source), F.col(layout.outcome).isNotNull(),
             F.col(layout.formation).isNotNull(), side]
    conds += [F.col(c).isNotNull() for c in extra_required]
    return df.filter(_all(conds))


def complete_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null (or NaN) in any column, or in ``subset``."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def frame_before_event(df: DataFrame, keys: Sequence[str], frame: str, event: str, event_value: str,
                       offset: int = 1, broadcast_limit: int | None = None) -> DataFrame:
    """Rows at frame ``last event frame - offset`` of each play.

    The last event frame per play is a partial (map-side) aggregate, so a hot
    play is pre-aggregated before the shuffle.  Joined back on the keys plus
    the wanted frame as an equi-join: when the per-play table fits the limit
    it is broadcast and the large frame table is filtered where it is read,
    with no shuffle at all; else a shuffle join, with AQE splitting hot keys.
    A play whose event is on its first frame has no earlier frame and drops.
    """
    snap = (df.filter(F.col(event) == F.lit(event_value))
            .groupBy(*keys)
            .agg((F.max(frame) - F.lit(offset)).alias("_wanted_frame")))
    snap = snap.select(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], "_wanted_frame")
    snap = bounded_broadcast(snap, broadcast_limit)
    cond = [F.col(k) == F.col(f"_k_{i}") for i, k in enumerate(keys)]
    cond.append(F.col(frame) == F.col("_wanted_frame"))
    cond_all = cond[0]
    for c in cond[1:]:
        cond_all = cond_all & c
    return df.join(snap, cond_all, "inner").select(*[F.col(f"`{c}`") for c in df.columns])


def previous_row_before_last(df: DataFrame, key: str, order: Sequence[str], event: str, event_value: str,
                             carry: Sequence[str] = (), broadcast_limit: int | None = None) -> DataFrame:
    """Frame before the last ``event_value`` row of each key when frames are an
    order (timestamps, ids) rather than consecutive integers.

    Output: key, ``frame_no`` (1-based position of the chosen row in the key's
    order, as ``row_number`` would give), the order columns and ``carry``.
    Built from two partial aggregates and one equi-join, never a window over a
    whole key, so a key holding a third of all rows is still spread over all
    tasks.  The order columns must identify a row within its key (a
    timestamp plus an event id); rows with a null order value are not placed.
    """
    df = df.filter(not_null(order))
    ord_struct = F.struct(*[F.col(c) for c in order])
    snap = (df.filter(F.col(event) == F.lit(event_value))
            .groupBy(key).agg(F.max(ord_struct).alias("_snap")))
    snap = bounded_broadcast(snap, broadcast_limit)
    before = (df.join(snap, key, "inner")
              .filter(ord_struct < F.col("_snap")))
    row_struct = F.struct(*[F.col(c) for c in list(order) + [c for c in carry if c not in order]])
    agg = before.groupBy(key).agg(F.max(row_struct).alias("_prev"), F.count(F.lit(1)).alias("frame_no"))
    cols = [F.col(key), F.col("frame_no")]
    cols += [F.col(f"_prev.{c}").alias(c) for c in list(order) + [c for c in carry if c not in order]]
    return agg.select(*cols)
