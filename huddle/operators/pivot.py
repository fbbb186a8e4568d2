"""Wide features (G8, G9), interactions (P11) and side pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huddle.functions.expressions import direction_label
from huddle.layout import FULL_SLOTS, Layout, Slot
from huddle.operators.slots import INDEX, rank_in_role, role_counts


def wide_features(rows: DataFrame, layout: Layout, slots: Sequence[Slot] = FULL_SLOTS,
                  attributes: Sequence[str] | None = None, count_role: str | None = "TE",
                  count_name: str = "num_TEs", complete: bool = True) -> DataFrame:
    """One row per play: for every slot ``<slot>_y`` (lateral offset from the
    center; the center keeps its absolute coordinate, B6), ``<slot>_dir``,
    ``<slot>_o``; plus label and play attributes and the role count.

    ``rows`` are event-frame rows (see ``event_frame_filter``):

    * every role is ranked by a limited ``row_number`` (partial
      WindowGroupLimit before the shuffle, so a hot play never reaches one
      task whole);
    * the pivot is ONE conditional aggregate grouped by the play keys and the
      play attributes, which are functions of the play (the pivot with
      explicit values, without a second aggregate); its cells are plain
      maxima, so it is a hash aggregate;
    * the role count, which the limit would spoil, is a partial aggregate of
      its own, joined on the play keys;
    * ``complete``: drop plays with any null (B1: plays lacking a slot go).
    """
    keys = list(layout.keys)
    label = layout.label
    if attributes is None:
        attributes = [label, layout.team, layout.formation]
    base = rows
    if label not in base.columns:
        base = base.withColumn(label, direction_label(layout.label_source, layout.left_tokens,
                                                      layout.right_tokens))
    roles = sorted({s.role for s in slots})
    limit = max([s.index or 1 for s in slots], default=1)
    ranked = rank_in_role(base.filter(F.col(layout.role).isin(roles)), layout, limit)

    aggs = []
    for s in slots:
        for field, col in (("lat", layout.lateral), ("dir", layout.heading), ("o", layout.facing)):
            # one SQL expression per cell: a single call to the JVM instead of one per node
            aggs.append(F.expr(f"max(CASE WHEN `{layout.role}` = '{s.role}' AND `{INDEX}` = {s.index or 1} "
                               f"THEN `{col}` END)").alias(f"_{s.name}_{field}"))
    wide = ranked.groupBy(*keys, *attributes).agg(*aggs)
    if count_role is not None:
        counts = role_counts(base, layout, count_role, count_name)
        wide = wide.join(counts, keys, "left").withColumn(count_name, F.coalesce(count_name, F.lit(0).cast("long")))

    # raw cells first, the any-null filter on them, then offsets from the center:
    # the filter sees plain columns (no alias chains for constraint inference)
    center = next((s for s in slots if s.role == "C"), None)
    raw = [F.col(k) for k in keys] + [F.col(a) for a in attributes]
    if count_role is not None:
        raw.append(F.col(count_name).cast("int").alias(count_name))
    for s in slots:
        raw += [F.col(f"_{s.name}_lat").alias(f"_{s.name}_lat_v"), F.col(f"_{s.name}_dir").alias(f"{s.name}_dir"),
                F.col(f"_{s.name}_o").alias(f"{s.name}_o")]
    out = wide.select(*raw)
    if complete:
        out = out.dropna(how="any")
    cols = [F.col(k) for k in keys] + [F.col(a) for a in attributes]
    if count_role is not None:
        cols.append(F.col(count_name))
    for s in slots:
        lat = F.col(f"_{s.name}_lat_v")
        if center is not None and s.name != center.name:
            lat = lat - F.col(f"_{center.name}_lat_v")
        cols += [lat.alias(f"{s.name}_y"), F.col(f"{s.name}_dir"), F.col(f"{s.name}_o")]
    return out.select(*cols)


def interaction_features(wide: DataFrame, slots: Sequence[Slot] = FULL_SLOTS) -> DataFrame:
    """``<slot>_dir_o = <slot>_dir * <slot>_o`` for every slot present (P11, once: B17)."""
    out = wide
    for s in slots:
        d, o = f"{s.name}_dir", f"{s.name}_o"
        if d in wide.columns and o in wide.columns:
            out = out.withColumn(f"{s.name}_dir_o", F.col(d) * F.col(o))
    return out


SIDE_MEASURES = (("dir", "avg_dir"), ("o", "avg_o"), ("yrel", "avg_yrel"))


def pivot_sides(rows: DataFrame, group: Sequence[str], side: str, measures: dict[str, str],
                sides: Sequence[str] = ("left", "right")) -> DataFrame:
    """Per group, the mean of each measure on each side: ``<side>_<alias>``
    (G7 + G10 in one aggregate: ``avg(when(side, m))`` is the mean over that
    side's rows, so no second group-by on (group, side) is needed)."""
    aggs = []
    for sv in sides:
        for alias, col in measures.items():
            aggs.append(F.expr(f"avg(CASE WHEN `{side}` = '{sv}' THEN `{col}` END)").alias(f"{sv}_{alias}"))
    return rows.groupBy(*group).agg(*aggs)


def side_difference(df: DataFrame, aliases: Sequence[str] = ("dir", "o", "yrel"),
                    sides: tuple[str, str] = ("left", "right")) -> DataFrame:
    """``<alias>_diff = |left - right|`` and ``total_diff`` their sum (P12);
    a null on either side gives null (one-sided players)."""
    out = df
    total = None
    for a in aliases:
        d = F.abs(F.col(f"{sides[0]}_{a}") - F.col(f"{sides[1]}_{a}"))
        out = out.withColumn(f"{a}_diff", d)
        total = F.col(f"{a}_diff") if total is None else total + F.col(f"{a}_diff")
    return out.withColumn("total_diff", total)
