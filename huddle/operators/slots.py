"""Ranking within a role, slot naming, role counts and the center reference
(W1, P5-P8, G1, J5, J6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huddle.functions.expressions import center_offset, slot_name
from huddle.layout import Layout, Slot
from huddle.session import bounded_broadcast

INDEX = "position_index"
SLOT = "true_position"


def order_columns(layout: Layout) -> list[str]:
    return [layout.lateral, *layout.tiebreak]


def rank_in_role(df: DataFrame, layout: Layout, limit: int | None = None) -> DataFrame:
    """``row_number`` within (play keys, role) by the lateral coordinate, ties
    broken by the layout's tie-break columns (B3).

    With ``limit`` only ranks <= limit are kept.  The filter sits directly on
    the rank, so Spark plans a partial WindowGroupLimit before the shuffle:
    each map task forwards at most ``limit`` rows per group, and a hot play
    never reaches one task whole."""
    w = Window.partitionBy(*layout.keys, layout.role).orderBy(*order_columns(layout))
    out = df.withColumn(INDEX, F.row_number().over(w))
    return out if limit is None else out.filter(F.col(INDEX) <= F.lit(limit))


def slot_assign(df: DataFrame, layout: Layout, slots: Sequence[Slot]) -> DataFrame:
    """Name each row's slot; rows without a slot are dropped.

    Roles whose slots have indexes are ranked with a limited window; rows of
    roles whose slot takes every row (``index=None``) need no rank and no
    shuffle: the two are a union over the same input, read once for each."""
    ranked_roles = sorted({s.role for s in slots if s.index is not None})
    all_roles = sorted({s.role for s in slots if s.index is None})
    limit = max([s.index for s in slots if s.index is not None], default=1)
    role = F.col(layout.role)
    out = rank_in_role(df.filter(role.isin(ranked_roles)), layout, limit)
    if all_roles:
        out = out.unionByName(df.filter(role.isin(all_roles)).withColumn(INDEX, F.lit(None).cast("int")))
    out = out.withColumn(SLOT, slot_name(layout.role, INDEX, slots))
    return out.filter(F.col(SLOT).isNotNull())


def role_counts(df: DataFrame, layout: Layout, role_value: str = "TE", name: str = "num_TEs",
                only_present: bool = True) -> DataFrame:
    """Rows of one role per play (G1).  ``only_present``: plays without the
    role are absent (the plain group-by); else they count 0.  A partial
    aggregate: each map task sends one row per play."""
    if only_present:
        return (df.filter(F.col(layout.role) == F.lit(role_value))
                .groupBy(*layout.keys).agg(F.count(F.lit(1)).alias(name)))
    return df.groupBy(*layout.keys).agg(
        F.count(F.when(F.col(layout.role) == F.lit(role_value), F.lit(1))).alias(name))


def center_reference(df: DataFrame, layout: Layout, center_role: str = "C", name: str = "center_y") -> DataFrame:
    """The center's lateral coordinate per play: one center per play, the
    first by lateral order (so two centers never fan a join out, B8).  A
    partial ``min`` over a struct: skew-safe."""
    key = F.struct(*[F.col(c) for c in order_columns(layout)])
    return (df.filter(F.col(layout.role) == F.lit(center_role))
            .groupBy(*layout.keys)
            .agg(F.min(key).getField(layout.lateral).alias(name)))


def with_center_offset(df: DataFrame, layout: Layout, inner: bool = False, mode: str = "zero",
                       name: str = "y_rel_C", center_rows: DataFrame | None = None) -> DataFrame:
    """Attach the center's coordinate and the offset from it.
    ``inner=False`` keeps plays without a center (offset null), as the player
    study does; the per-play table is broadcast when it fits the limit.

    ``center_rows``: the rows before slot ranking.  The center is the same
    from either (every center row qualifies), but from these the center filter
    reaches the scan, instead of re-running the ranking window."""
    cy = bounded_broadcast(center_reference(center_rows if center_rows is not None else df, layout))
    out = df.join(cy, list(layout.keys), "inner" if inner else "left")
    slot_col = SLOT if SLOT in df.columns else None
    return out.withColumn(name, center_offset(layout.lateral, "center_y", slot_col, "C", mode))
