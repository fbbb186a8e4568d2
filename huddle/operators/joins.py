"""Joins: the tracking merge (J1-J3), the fan-out guard for name joins (J4),
and metric-to-metric joins (J8-J10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huddle.session import bounded_broadcast

Pairs = Sequence[tuple[str, str]] | Sequence[str]


def _pairs(on: Pairs) -> list[tuple[str, str]]:
    return [(p, p) if isinstance(p, str) else (p[0], p[1]) for p in on]


def join_left(left: DataFrame, right: DataFrame, on: Pairs, broadcast_limit: int | None = None) -> DataFrame:
    """Left join on key pairs.  Same-named keys appear once (as ``on=[...]``
    does); differently named keys keep both columns.  The right side is
    broadcast only when its estimated size is under the limit."""
    pairs = _pairs(on)
    right = bounded_broadcast(right, broadcast_limit)
    if all(a == b for a, b in pairs):
        return left.join(right, [a for a, _ in pairs], "left")
    cond = None
    for a, b in pairs:
        e = left[a] == right[b]
        cond = e if cond is None else (cond & e)
    return left.join(right, cond, "left")


def hot_keys(left: DataFrame, keys: Sequence[str], shares: int = 1000) -> DataFrame:
    """Keys that hold at least a ``shares``-th of all rows of ``left``, with
    ``salts``, the number of such shares they hold.  There are at most
    ``shares`` of them whatever the size of ``left``, so this side may be
    broadcast.  Counted exactly, by partial aggregates; null keys are left out
    (they match nothing)."""
    total = left.count()
    known = left
    for k in keys:
        known = known.filter(F.col(k).isNotNull())
    counts = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") * shares >= max(total, 1))
    return hot.select(*keys, F.ceil(F.col("_n") * shares / F.lit(max(total, 1))).cast("int").alias("salts"))


def skewed_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
                spread_by: Sequence[str] = (), shares: int = 1000, hot: DataFrame | None = None) -> DataFrame:
    """``left.join(right, on, how)`` (inner or left) that holds when one key
    has a third of the rows of ``left`` and ``right`` cannot be broadcast.

    The rows of a hot key (see :func:`hot_keys`) are dealt over as many salts
    as it holds shares, by a hash of ``spread_by`` (default: all columns), and
    the ``right`` rows of that key are repeated once a salt; all other keys
    have one salt.  The repeats add at most 2 x ``shares`` times the largest
    number of ``right`` rows of one key.  Rows of ``left`` with a null key
    match nothing and are dealt over all salts.  The result has the rows of
    the plain join, repeated rows and fan-out included."""
    if how not in ("inner", "left"):
        raise ValueError(how)
    keys = list(on)
    hot = F.broadcast(hot_keys(left, keys, shares) if hot is None else hot)
    by = F.xxhash64(*(spread_by or left.columns))
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    salt = F.when(no_key, F.pmod(by, F.lit(shares))).otherwise(F.pmod(by, F.coalesce(F.col("salts"), F.lit(1))))
    dealt = left.join(hot, keys, "left").withColumn("_salt", salt.cast("int")).drop("salts")
    copies = right.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))).drop("salts")
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


def join_on_name(facts: DataFrame, dim: DataFrame, name: str, spread_by: Sequence[str] = (),
                 shares: int = 1000) -> DataFrame:
    """facts LEFT dim on a name that both call ``name`` (J3): every row the
    left join yields, so a fact row comes once per dimension row of its name
    and unmatched facts stay.  A dimension that fits is broadcast; else hot
    names are salted."""
    small = bounded_broadcast(dim)
    if small is not dim:
        return facts.join(small, [name], "left")
    return skewed_join(facts, dim, [name], "left", spread_by, shares)


def merge_frames(tracking: DataFrame, plays: DataFrame, games: DataFrame, players: DataFrame,
                 play_on: Pairs = ("gameId", "playId"), game_on: Pairs = ("gameId",),
                 player_on: Pairs = ("displayName",), rename: dict[str, str] | None = None) -> DataFrame:
    """tracking LEFT plays LEFT games LEFT players, in that order.

    ``rename`` renames player columns first to avoid a clash (nflId ->
    player_nflId).  Plays, games and players are dimensions: each is broadcast
    when it fits the limit, so the large tracking side is never shuffled for
    them.  Joining players on a name fans out when names repeat (B9): check
    with :func:`fanout_report` first.
    """
    for old, new in (rename or {}).items():
        players = players.withColumnRenamed(old, new)
    out = join_left(tracking, plays, play_on)
    out = join_left(out, games, game_on)
    return join_left(out, players, player_on)


def fanout_report(dim: DataFrame, key: str, id_col: str | None = None) -> DataFrame:
    """Keys of a dimension that match more than one row: every fact row with
    such a key is duplicated by a left join.  One row per duplicated key with
    its multiplicity (and the smallest and largest id when given)."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if id_col:
        aggs += [F.min(id_col).alias("min_id"), F.max(id_col).alias("max_id")]
    return dim.groupBy(key).agg(*aggs).filter(F.col("n_rows") > 1)


def fanout_join_summary(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str) -> DataFrame:
    """What a many-to-many name join would produce, without producing it:
    per key, fact rows, dimension rows and output rows (their product).
    The dimension is reduced to one row per key before the join, so the
    join itself cannot fan out."""
    per_key = dim.groupBy(dim_key).agg(F.count(F.lit(1)).alias("dim_rows"))
    fact_counts = facts.groupBy(fact_key).agg(F.count(F.lit(1)).alias("fact_rows"))
    j = fact_counts.join(bounded_broadcast(per_key), fact_counts[fact_key] == per_key[dim_key], "left")
    return j.select(
        F.col(fact_key),
        F.col("fact_rows"),
        F.coalesce(F.col("dim_rows"), F.lit(0)).cast("bigint").alias("dim_rows"),
        (F.col("fact_rows") * F.greatest(F.coalesce(F.col("dim_rows"), F.lit(0)), F.lit(1)))
        .cast("bigint").alias("joined_rows"),
    )


def join_metrics(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join two per-segment metric tables (avg yards with accuracy).  Both are
    one row per segment, so this never fans out."""
    return left.join(bounded_broadcast(right), on, how)
