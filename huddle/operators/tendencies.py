"""Segment averages, per-player side tendencies and leaderboards
(G3-G7, G11-G13, F13, T1-T6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huddle.functions.expressions import is_run
from huddle.layout import Layout


def avg_by(df: DataFrame, group: Sequence[str], value: str, name: str = "avg_yards") -> DataFrame:
    """Mean of ``value`` per group (partial aggregate: skew-safe)."""
    return df.groupBy(*group).agg(F.avg(value).alias(name))


def rushing_rows(frames: DataFrame, layout: Layout) -> DataFrame:
    """Run plays with a location and an outcome."""
    return frames.filter(is_run(layout.pass_col, layout.label_source)
                         & F.col(layout.outcome).isNotNull())


def avg_by_team(frames: DataFrame, layout: Layout) -> DataFrame:
    """Row-weighted mean outcome per team (G3, B11: plays weigh by rows)."""
    return avg_by(rushing_rows(frames, layout), [layout.team], layout.outcome)


def avg_by_team_per_play(frames: DataFrame, layout: Layout) -> DataFrame:
    """Mean outcome per team with each play counted once (G4).  The play is
    reduced by a partial aggregate on its keys first, then averaged."""
    plays = (rushing_rows(frames, layout)
             .groupBy(*layout.keys)
             .agg(F.max(layout.team).alias(layout.team), F.max(layout.outcome).alias(layout.outcome)))
    return avg_by(plays, [layout.team], layout.outcome)


def avg_by_formation(sided_rows: DataFrame, layout: Layout, name: str = "avg_yards_lr") -> DataFrame:
    """Mean outcome per formation on left/right runs (G5); sorted best first."""
    return avg_by(sided_rows, [layout.formation], layout.outcome, name).orderBy(F.col(name).desc())


def min_group_size(df: DataFrame, group: Sequence[str], minimum: int, name: str = "num_samples") -> DataFrame:
    """Rows of groups with at least ``minimum`` rows, with the group size
    attached (F13, G13).  Sizes come from a partial aggregate joined back
    (broadcast when the size table fits), not a window over whole groups."""
    from huddle.session import bounded_broadcast
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) >= minimum)
    return df.join(bounded_broadcast(sizes), list(group), "inner")


def distinct_segments(df: DataFrame, col: str) -> DataFrame:
    """Distinct segment values."""
    return df.select(col).distinct()


def first_attribute(df: DataFrame, group: Sequence[str], attrs: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The attributes of each group's first row by ``order`` (G12,
    deterministic ``iloc[0]``), plus the group's row count.  ``min`` over a
    struct is a partial aggregate."""
    key = F.struct(*[F.col(c) for c in order], *[F.col(a).alias(f"_a_{a}") for a in attrs])
    agg = df.groupBy(*group).agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("num_samples"))
    return agg.select(*group, *[F.col(f"_first._a_{a}").alias(a) for a in attrs], "num_samples")


def leaderboard_total(diff: DataFrame, tiebreak: Sequence[str], n: int = 20, col: str = "total_diff") -> DataFrame:
    """Top ``n`` by ``col`` descending, nulls last (T2).  ``orderBy+limit`` is a
    per-partition top-n merged on the driver: n rows per task, never a sort of
    the whole table."""
    return diff.orderBy(F.col(col).desc_nulls_last(), *[F.col(c).asc() for c in tiebreak]).limit(n)


def leaderboard_by_feature(diff: DataFrame, id_cols: Sequence[str], features: Sequence[str],
                           n: int = 10) -> DataFrame:
    """Top ``n`` per feature (T3): unpivot to (feature, value) with ``stack``
    and rank within each feature.  The rank filter is a pure
    ``row_number <= n``, so Spark limits each feature's rows per map task
    before the shuffle (each feature group holds every player)."""
    long = diff.unpivot(list(id_cols), list(features), "feature", "value")
    w = Window.partitionBy("feature").orderBy(F.col("value").desc_nulls_last(), *[F.col(c) for c in id_cols])
    return long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_bottom(df: DataFrame, col: str, tiebreak: Sequence[str], n: int) -> DataFrame:
    """The ``n`` highest and ``n`` lowest rows by ``col`` (T5, T6, U2), each
    tagged with its end.  With fewer than 2n rows a row can appear in both,
    as in the reference's concatenation."""
    tb = [F.col(c).asc() for c in tiebreak]
    top = df.orderBy(F.col(col).desc(), *tb).limit(n).withColumn("end", F.lit("top"))
    bottom = df.orderBy(F.col(col).asc(), *tb).limit(n).withColumn("end", F.lit("bottom"))
    return top.unionByName(bottom)
