"""Registered queries on the driver tables, each with its DuckDB oracle SQL.

Each query callable takes ``(spark, sf_dir)`` and returns a DataFrame over
whole tables.  The SQL twin of a key runs on the same Parquet tables (views
``lineitem orders customer part events ...``).  Computed doubles that come
from sums are rounded on both sides with the same arithmetic (``rnd`` and
``scaled_rounds``: summation order differs between engines, and their own
``round`` functions differ on half-way values); money means are exact
decimals; differences and products of stored values are exact and not
rounded.  Results agree bit for bit (``tools/check_oracle.py --exact``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huddle.layout import DRIVER, FULL_SLOTS, LINE_SLOTS
from huddle.sources.standin import FRAMES_SQL, driver_frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = scaled_rounds(sql)
        return fn
    return deco


def scaled_rounds(sql: str) -> str:
    """Rewrite every ``round(expr, k)`` as ``round((expr) * 10^k) / 10^k``,
    the same arithmetic ``rnd`` does in Spark: one IEEE multiply, a round to
    integer, one IEEE divide, so both engines give the same double (their
    own ``round(x, k)`` differ on half-way values)."""
    out, i = [], 0
    low = sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, comma = 0, j + 5, -1
        while True:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
                if depth == 0:
                    break
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner = sql[j + 6:comma] if comma > 0 else sql[j + 6:k]
        places = sql[comma + 1:k].strip() if comma > 0 else "0"
        scale = "1" + "0" * int(places) + ".0"
        out.append(sql[i:j] + f"(round(({scaled_rounds(inner)}) * {scale}) / {scale})")
        i = k + 1


def with_frames(body: str) -> str:
    return "WITH " + FRAMES_SQL.strip() + ",\n" + body


def rnd(col, places: int = 6):
    """Round to ``places`` decimals as ``round(x * 10^k) / 10^k`` (see
    ``scaled_rounds``: the SQL twins do the same arithmetic)."""
    c = F.col(col) if isinstance(col, str) else col
    scale = float(10 ** places)
    return F.round(c * F.lit(scale)) / F.lit(scale)


# --------------------------------------------------------------------------
# shared SQL fragments for the stand-in
# --------------------------------------------------------------------------
KEYS_SQL = "o_custkey, l_orderkey"
ORDER_SQL = "l_extendedprice, l_linenumber, l_partkey"
RUN_ROWS_SQL = """
rr AS (
  SELECT * FROM frames
  WHERE o_orderpriority IS NOT NULL AND pos IN ('T','G','C','TE')
    AND l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL
    AND l_discount IS NOT NULL AND l_tax IS NOT NULL
)"""


def _wide_sql(slots, with_attrs: bool) -> str:
    roles = sorted({s.role for s in slots})
    role_list = ", ".join(f"'{r}'" for r in roles)
    picks = []
    for s in slots:
        cond = f"pos = '{s.role}' AND rn = {s.index}"
        picks.append(f"max(CASE WHEN {cond} THEN l_extendedprice END) AS lat_{s.name}")
        picks.append(f"max(CASE WHEN {cond} THEN l_quantity END) AS {s.name}_dir")
        picks.append(f"max(CASE WHEN {cond} THEN l_discount END) AS {s.name}_o")
    attrs = "max(run_dir) AS run_dir"
    if with_attrs:
        attrs += ", max(c_mktsegment) AS c_mktsegment, max(o_orderstatus) AS o_orderstatus"
    outs = []
    for s in slots:
        y = f"lat_{s.name}" if s.name == "C" else f"lat_{s.name} - lat_C"
        outs += [f"{y} AS {s.name}_y", f"{s.name}_dir", f"{s.name}_o"]
    sel_attrs = "w.run_dir" + (", w.c_mktsegment, w.o_orderstatus, CAST(coalesce(t.n, 0) AS INTEGER) AS num_TEs"
                               if with_attrs else "")
    counts = (", te AS (SELECT " + KEYS_SQL + ", count(*) AS n FROM rr WHERE pos = 'TE' GROUP BY "
              + KEYS_SQL + ")") if with_attrs else ""
    join = (" LEFT JOIN te t ON w.o_custkey = t.o_custkey AND w.l_orderkey = t.l_orderkey"
            if with_attrs else "")
    all_cols = ["o_custkey", "l_orderkey", "run_dir"] + (["c_mktsegment", "o_orderstatus", "num_TEs"] if with_attrs else [])
    all_cols += [f"{s.name}_{m}" for s in slots for m in ("y", "dir", "o")]
    not_null = " AND ".join(f"{c} IS NOT NULL" for c in all_cols)
    return with_frames(f"""{RUN_ROWS_SQL},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {KEYS_SQL}, pos ORDER BY {ORDER_SQL}) AS rn
  FROM rr WHERE pos IN ({role_list})
),
w AS (
  SELECT {KEYS_SQL}, {attrs}, {", ".join(picks)}
  FROM ranked GROUP BY {KEYS_SQL}
){counts},
o AS (
  SELECT w.o_custkey, w.l_orderkey, {sel_attrs}, {", ".join(outs)}
  FROM w{join}
)
SELECT * FROM o WHERE {not_null}""")


@register("wide_features", _wide_sql(FULL_SLOTS, True))
def q_wide_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from huddle.plans.features import snap_features
    return snap_features(driver_frames(spark, sf_dir, "customer"), DRIVER, event_value=None)


@register("wide_features_line_only", _wide_sql(LINE_SLOTS, False))
def q_wide_features_line_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    from huddle.plans.features import line_only_features
    return line_only_features(driver_frames(spark, sf_dir), DRIVER, event_value=None)


# --------------------------------------------------------------------------
# projections and labels
# --------------------------------------------------------------------------
def _frames(spark, sf_dir, *dimensions):
    return driver_frames(spark, sf_dir, *dimensions)


@register("classify_play", with_frames("""
o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority,
        CASE WHEN o_orderstatus = 'P' THEN o_orderstatus END AS pass_result FROM orders)
SELECT o_orderkey, CASE WHEN pass_result IS NOT NULL THEN 'pass'
                        WHEN o_orderpriority IS NOT NULL THEN 'run' END AS playType
FROM o"""))
def q_classify_play(spark, sf_dir):
    """P2 on orders: a pending order stands for a pass result, the priority
    text for a run location; pass wins when both are set."""
    from huddle.functions.expressions import classify_play
    from huddle.sources.readers import read_table
    o = read_table(spark, sf_dir, "orders")
    pass_result = F.when(F.col("o_orderstatus") == "P", F.col("o_orderstatus"))
    return o.select("o_orderkey", classify_play(pass_result, "o_orderpriority").alias("playType"))


@register("direction_label", """
SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%URGENT%' OR o_orderpriority LIKE '%HIGH%' THEN 'left'
                        WHEN o_orderpriority LIKE '%LOW%' OR o_orderpriority LIKE '%NOT%' THEN 'right' END AS run_dir
FROM orders""")
def q_direction_label(spark, sf_dir):
    from huddle.functions.expressions import direction_label
    from huddle.sources.readers import read_table
    o = read_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", direction_label("o_orderpriority", DRIVER.left_tokens,
                                                  DRIVER.right_tokens).alias("run_dir"))


@register("relative_offset", with_frames("""
SELECT l_orderkey, l_linenumber, l_partkey, l_tax - l_discount AS x_rel_los FROM frames"""))
def q_relative_offset(spark, sf_dir):
    from huddle.functions.expressions import relative_offset
    f = _frames(spark, sf_dir)
    return f.select("l_orderkey", "l_linenumber", "l_partkey",
                    relative_offset(DRIVER.x, DRIVER.line_of_scrimmage).alias("x_rel_los"))


@register("rename_columns", """
SELECT p_partkey AS player_p_partkey, p_name, p_brand FROM part""")
def q_rename_columns(spark, sf_dir):
    from huddle.sources.readers import read_table
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return p.withColumnRenamed("p_partkey", "player_p_partkey")


@register("interaction_features", _wide_sql(FULL_SLOTS, True).replace(
    "SELECT * FROM o WHERE", "SELECT *, " + ", ".join(f"{s.name}_dir * {s.name}_o AS {s.name}_dir_o"
                                                     for s in FULL_SLOTS) + " FROM o WHERE"))
def q_interaction_features(spark, sf_dir):
    from huddle.operators.pivot import interaction_features
    return interaction_features(q_wide_features(spark, sf_dir), FULL_SLOTS)


@register("map_lookup_default", """
SELECT c_custkey, c_mktsegment,
  coalesce(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'ARI' WHEN 'BUILDING' THEN 'BAL'
                             WHEN 'FURNITURE' THEN 'DAL' WHEN 'HOUSEHOLD' THEN 'NO' END, '?') AS team,
  coalesce(CASE coalesce(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'ARI' WHEN 'BUILDING' THEN 'BAL'
                             WHEN 'FURNITURE' THEN 'DAL' WHEN 'HOUSEHOLD' THEN 'NO' END, '?')
           WHEN 'ARI' THEN '#97233F' WHEN 'BAL' THEN '#241773' WHEN 'DAL' THEN '#041E42'
           WHEN 'NO' THEN '#D3BC8D' END, '#333333') AS color
FROM customer""")
def q_map_lookup_default(spark, sf_dir):
    """Segment -> a team code (a stand-in table; MACHINERY has none),
    then team -> colour with the default colour for unknown teams."""
    from huddle.functions.expressions import DEFAULT_COLOR, TEAM_COLORS, map_lookup
    from huddle.sources.readers import read_table
    segment_team = {"AUTOMOBILE": "ARI", "BUILDING": "BAL", "FURNITURE": "DAL", "HOUSEHOLD": "NO"}
    c = read_table(spark, sf_dir, "customer")
    team = map_lookup("c_mktsegment", segment_team, "?")
    return c.select("c_custkey", "c_mktsegment", team.alias("team"),
                    map_lookup(team, TEAM_COLORS, DEFAULT_COLOR).alias("color"))


@register("fill_numeric_nulls", """
WITH c AS (SELECT c_custkey, count(*) AS n_orders, max(o_totalprice) AS max_total
           FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT c.c_custkey, cu.c_mktsegment, CASE WHEN max_total IS NULL THEN 0 ELSE n_orders END AS n_orders,
       coalesce(max_total, 0) AS max_total
FROM c JOIN customer cu ON c.c_custkey = cu.c_custkey""")
def q_fill_numeric_nulls(spark, sf_dir):
    """P10: customers without orders get null counts after a left join;
    ``fillna(0, subset)`` fills the named numeric columns only."""
    from huddle.sources.readers import read_table
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    o = read_table(spark, sf_dir, "orders")
    per = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("max_total"))
    j = c.join(per, c.c_custkey == per.o_custkey, "left").drop("o_custkey")
    return j.fillna(0, subset=["n_orders", "max_total"])


# --------------------------------------------------------------------------
# filters
# --------------------------------------------------------------------------
_REQ_SQL = ("l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL AND l_discount IS NOT NULL "
            "AND l_tax IS NOT NULL")
_ROW_ID = ["l_orderkey", "l_linenumber", "l_partkey"]


@register("event_frame_filter", with_frames(f"""
SELECT l_orderkey, l_linenumber, l_partkey, pos, run_dir FROM frames
WHERE o_orderpriority IS NOT NULL AND pos IN ('T','G','C','TE') AND {_REQ_SQL}"""))
def q_event_frame_filter(spark, sf_dir):
    from huddle.operators.frames import event_frame_filter
    return event_frame_filter(_frames(spark, sf_dir), DRIVER, None).select(*_ROW_ID, "pos", "run_dir")


@register("event_frame_filter_alt", with_frames(f"""
SELECT l_orderkey, l_linenumber, l_partkey, pos FROM frames
WHERE o_orderpriority IS NOT NULL AND pos IN ('T','G','C') AND {_REQ_SQL}"""))
def q_event_frame_filter_alt(spark, sf_dir):
    """the same filter with another role set (line only)."""
    from huddle.operators.frames import event_frame_filter
    return event_frame_filter(_frames(spark, sf_dir), DRIVER, None, roles=["T", "G", "C"]).select(*_ROW_ID, "pos")


# An event tag for the stand-in: every third frame of a play is a snap, the
# one after it a line set, the rest have none.
_EVENT_SQL = """
ev AS (SELECT *, CASE WHEN l_linenumber % 3 = 1 THEN 'ball_snap' WHEN l_linenumber % 3 = 2 THEN 'line_set' END AS event FROM frames)"""


def _event_frames(spark, sf_dir):
    """The stand-in with an event column, and its layout."""
    from dataclasses import replace
    at = F.col("l_linenumber") % 3
    tagged = _frames(spark, sf_dir).withColumn("event", F.when(at == 1, "ball_snap").when(at == 2, "line_set"))
    return tagged, replace(DRIVER, frame="l_linenumber", event="event")


_AT_EVENT_SQL = _EVENT_SQL + """
SELECT l_orderkey, l_linenumber, l_partkey, pos, run_dir, event FROM ev
WHERE event = '{event}' AND o_orderpriority IS NOT NULL AND pos IN ('T','G','C','TE')
  AND l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL"""


@register("event_frame_filter_snap", with_frames(_AT_EVENT_SQL.format(event="ball_snap")))
def q_event_frame_filter_snap(spark, sf_dir):
    """F1 whole: run plays at the snap, in the line roles, measures present."""
    from huddle.operators.frames import event_frame_filter
    f, layout = _event_frames(spark, sf_dir)
    return event_frame_filter(f, layout, "ball_snap").select(*_ROW_ID, "pos", "run_dir", "event")


@register("event_frame_filter_line_set", with_frames(_AT_EVENT_SQL.format(event="line_set")))
def q_event_frame_filter_line_set(spark, sf_dir):
    """the same filter at the line set."""
    from huddle.operators.frames import event_frame_filter
    f, layout = _event_frames(spark, sf_dir)
    return event_frame_filter(f, layout, "line_set").select(*_ROW_ID, "pos", "run_dir", "event")


@register("event_frame_filter_before_snap", with_frames(_EVENT_SQL + """,
w AS (SELECT o_custkey AS k1, l_orderkey AS k2, max(l_linenumber) - 1 AS wanted FROM ev WHERE event = 'ball_snap'
      GROUP BY o_custkey, l_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, pos, run_dir, l_tax - l_discount AS x_rel_los
FROM ev JOIN w ON o_custkey = k1 AND l_orderkey = k2 AND l_linenumber = wanted
WHERE o_orderpriority IS NOT NULL AND pos IN ('T','G','C','TE')
  AND l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL"""))
def q_event_frame_filter_before_snap(spark, sf_dir):
    """F3 whole: the same rows on the frame before the last snap of a play."""
    from huddle.plans.features import event_rows
    f, layout = _event_frames(spark, sf_dir)
    return event_rows(f, layout, "ball_snap", before_event=True).select(*_ROW_ID, "pos", "run_dir", "x_rel_los")


@register("regex_filter", with_frames(f"""
SELECT l_orderkey, l_linenumber, l_partkey, pos FROM frames
WHERE o_orderpriority IS NOT NULL AND regexp_matches(o_orderpriority, 'URGENT|HIGH|LOW|NOT')
  AND pos IN ('T','G','C','TE') AND {_REQ_SQL}"""))
def q_regex_filter(spark, sf_dir):
    from huddle.operators.frames import regex_filter
    return regex_filter(_frames(spark, sf_dir), DRIVER, None).select(*_ROW_ID, "pos")


@register("substring_or_filter", with_frames("""
SELECT l_orderkey, l_linenumber, l_partkey, o_orderstatus FROM frames
WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL
  AND (o_orderpriority LIKE '%URGENT%' OR o_orderpriority LIKE '%HIGH%'
       OR o_orderpriority LIKE '%LOW%' OR o_orderpriority LIKE '%NOT%')"""))
def q_substring_or_filter(spark, sf_dir):
    from huddle.operators.frames import substring_or_filter
    return substring_or_filter(_frames(spark, sf_dir), DRIVER).select(*_ROW_ID, "o_orderstatus")


@register("complete_rows", with_frames("""
SELECT l_orderkey, l_linenumber, l_partkey, run_dir, c_mktsegment FROM frames
WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL AND l_partkey IS NOT NULL
  AND run_dir IS NOT NULL AND c_mktsegment IS NOT NULL"""))
def q_complete_rows(spark, sf_dir):
    """any-null drop; the side label is null on MEDIUM priority."""
    from huddle.operators.frames import complete_rows
    return complete_rows(_frames(spark, sf_dir, "customer").select(*_ROW_ID, "run_dir", "c_mktsegment"))


@register("complete_rows_subset", """
WITH c AS (SELECT c_custkey, c_mktsegment, avg(o_totalprice) AS avg_total
           FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment)
SELECT c_custkey, c_mktsegment, round(avg_total, 6) AS avg_total FROM c WHERE avg_total IS NOT NULL""")
def q_complete_rows_subset(spark, sf_dir):
    """drop rows null in a subset (customers with no orders)."""
    from huddle.operators.frames import complete_rows
    from huddle.sources.readers import read_table
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    o = read_table(spark, sf_dir, "orders")
    per = o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("avg_total"))
    j = c.join(per, c.c_custkey == per.o_custkey, "left").select("c_custkey", "c_mktsegment",
                                                                 rnd("avg_total").alias("avg_total"))
    return complete_rows(j, ["avg_total"])


@register("min_group_size", with_frames("""
g AS (SELECT l_partkey, count(*) AS num_samples FROM frames GROUP BY l_partkey HAVING count(*) >= 40)
SELECT f.l_orderkey, f.l_linenumber, f.l_partkey, g.num_samples FROM frames f JOIN g ON f.l_partkey = g.l_partkey"""))
def q_min_group_size(spark, sf_dir):
    """Rows of players with at least 40 rows, with the group size."""
    from huddle.operators.tendencies import min_group_size
    f = _frames(spark, sf_dir).select(*_ROW_ID)
    return min_group_size(f, ["l_partkey"], 40)


# --------------------------------------------------------------------------
# slots, counts, center
# --------------------------------------------------------------------------
_RR_PREFIX = RUN_ROWS_SQL + ","


@register("rank_in_role", with_frames(_RR_PREFIX + f"""
r AS (SELECT {KEYS_SQL}, l_linenumber, l_partkey, pos,
        CAST(row_number() OVER (PARTITION BY {KEYS_SQL}, pos ORDER BY {ORDER_SQL}) AS INTEGER) AS position_index FROM rr)
SELECT * FROM r"""))
def q_rank_in_role(spark, sf_dir):
    """Every row's rank within its play and role."""
    from huddle.operators.frames import event_frame_filter
    from huddle.operators.slots import rank_in_role
    from huddle.sources.standin import sort_tasks
    rows = event_frame_filter(driver_frames(spark, sf_dir, tasks=sort_tasks(spark, sf_dir)), DRIVER, None)
    return rank_in_role(rows, DRIVER).select(*DRIVER.keys, "l_linenumber", "l_partkey", "pos", "position_index")


def _slot_sql(slots) -> str:
    whens = []
    for s in slots:
        cond = f"pos = '{s.role}'" + (f" AND position_index = {s.index}" if s.index is not None else "")
        whens.append(f"WHEN {cond} THEN '{s.name}'")
    roles = ", ".join(f"'{r}'" for r in sorted({s.role for s in slots}))
    return with_frames(_RR_PREFIX + f"""
r AS (SELECT {KEYS_SQL}, l_linenumber, l_partkey, pos,
        CAST(row_number() OVER (PARTITION BY {KEYS_SQL}, pos ORDER BY {ORDER_SQL}) AS INTEGER) AS position_index
      FROM rr WHERE pos IN ({roles})),
s AS (SELECT *, CASE {" ".join(whens)} END AS true_position FROM r)
SELECT {KEYS_SQL}, l_linenumber, l_partkey, pos, true_position FROM s WHERE true_position IS NOT NULL""")


@register("slot_assign", _slot_sql(FULL_SLOTS))
def q_slot_assign(spark, sf_dir):
    from huddle.operators.frames import event_frame_filter
    from huddle.operators.slots import slot_assign
    rows = event_frame_filter(_frames(spark, sf_dir), DRIVER, None)
    return slot_assign(rows, DRIVER, FULL_SLOTS).select(*DRIVER.keys, "l_linenumber", "l_partkey", "pos",
                                                        "true_position")


@register("slot_assign_line_only", _slot_sql(LINE_SLOTS))
def q_slot_assign_line_only(spark, sf_dir):
    from huddle.operators.frames import event_frame_filter
    from huddle.operators.slots import slot_assign
    rows = event_frame_filter(_frames(spark, sf_dir), DRIVER, None)
    return slot_assign(rows, DRIVER, LINE_SLOTS).select(*DRIVER.keys, "l_linenumber", "l_partkey", "pos",
                                                        "true_position")


@register("role_counts", with_frames(_RR_PREFIX + f"""
SELECT {KEYS_SQL}, count(*) AS num_TEs FROM rr WHERE pos = 'TE' GROUP BY {KEYS_SQL}"""))
def q_role_counts(spark, sf_dir):
    from huddle.operators.frames import event_frame_filter
    from huddle.operators.slots import role_counts
    rows = event_frame_filter(_frames(spark, sf_dir), DRIVER, None)
    return role_counts(rows, DRIVER, "TE", "num_TEs")


@register("slot_counts", with_frames(_RR_PREFIX + f"""
SELECT {KEYS_SQL}, count(CASE WHEN pos = 'TE' THEN 1 END) AS num_TEs FROM rr GROUP BY {KEYS_SQL}"""))
def q_slot_counts(spark, sf_dir):
    """The role count for every play (0 when absent), as joined back."""
    from huddle.operators.frames import event_frame_filter
    from huddle.operators.slots import role_counts
    rows = event_frame_filter(_frames(spark, sf_dir), DRIVER, None)
    return role_counts(rows, DRIVER, "TE", "num_TEs", only_present=False)


@register("center_reference", with_frames(_RR_PREFIX + f"""
SELECT {KEYS_SQL}, min(l_extendedprice) AS center_y FROM rr WHERE pos = 'C' GROUP BY {KEYS_SQL}"""))
def q_center_reference(spark, sf_dir):
    from huddle.operators.frames import event_frame_filter
    from huddle.operators.slots import center_reference
    rows = event_frame_filter(_frames(spark, sf_dir), DRIVER, None)
    return center_reference(rows, DRIVER)


def _center_offset_sql(inner: bool, mode: str) -> str:
    expr = ("CASE WHEN true_position = 'C' THEN lat ELSE lat - c.center_y END"
            if mode == "absolute" else "lat - c.center_y")
    whens = " ".join(f"WHEN pos = '{s.role}' AND position_index = {s.index} THEN '{s.name}'" for s in FULL_SLOTS)
    join = "JOIN" if inner else "LEFT JOIN"
    return with_frames(_RR_PREFIX + f"""
r AS (SELECT {KEYS_SQL}, l_linenumber, l_partkey, pos, l_extendedprice AS lat,
        CAST(row_number() OVER (PARTITION BY {KEYS_SQL}, pos ORDER BY {ORDER_SQL}) AS INTEGER) AS position_index FROM rr),
s AS (SELECT *, CASE {whens} END AS true_position FROM r),
c AS (SELECT {KEYS_SQL}, min(l_extendedprice) AS center_y FROM rr WHERE pos = 'C' GROUP BY {KEYS_SQL})
SELECT s.o_custkey, s.l_orderkey, s.l_linenumber, s.l_partkey, s.true_position, {expr} AS y_rel_C
FROM s {join} c ON s.o_custkey = c.o_custkey AND s.l_orderkey = c.l_orderkey
WHERE s.true_position IS NOT NULL""")


def _center_offset_q(spark, sf_dir, inner, mode):
    from huddle.operators.frames import event_frame_filter
    from huddle.operators.slots import slot_assign, with_center_offset
    rows = event_frame_filter(_frames(spark, sf_dir), DRIVER, None)
    slotted = slot_assign(rows, DRIVER, FULL_SLOTS)
    out = with_center_offset(slotted, DRIVER, inner=inner, mode=mode, center_rows=rows)
    return out.select(*DRIVER.keys, "l_linenumber", "l_partkey", "true_position", "y_rel_C")


@register("center_offset_abs", _center_offset_sql(True, "absolute"))
def q_center_offset_abs(spark, sf_dir):
    """P7 + J6 inner: the center keeps its absolute coordinate."""
    return _center_offset_q(spark, sf_dir, True, "absolute")


@register("center_offset_zero", _center_offset_sql(False, "zero"))
def q_center_offset_zero(spark, sf_dir):
    """P8 + J6 left: plain difference (center = 0); plays without a center keep a null."""
    return _center_offset_q(spark, sf_dir, False, "zero")


# --------------------------------------------------------------------------
# joins
# --------------------------------------------------------------------------
@register("join_left_composite", """
SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, o_orderstatus
FROM lineitem l LEFT JOIN orders o ON l_orderkey = o_orderkey""")
def q_join_left_composite(spark, sf_dir):
    """Frame rows LEFT play rows on the play key."""
    from huddle.operators.joins import join_left
    from huddle.sources.readers import read_table
    l = read_table(spark, sf_dir, "lineitem")
    o = read_table(spark, sf_dir, "orders")
    return join_left(l, o, [("l_orderkey", "o_orderkey")]).select(*_ROW_ID, "o_custkey", "o_orderstatus")


@register("bucketed_ranks", """
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
                  CASE WHEN l_returnflag = 'A' THEN 'T' WHEN l_returnflag = 'N' THEN 'G'
                       WHEN l_linestatus = 'F' THEN 'C' ELSE 'TE' END AS pos FROM lineitem),
c AS (SELECT l_orderkey AS k, count(*) AS n FROM t WHERE pos = 'TE' GROUP BY l_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, pos,
       CAST(row_number() OVER (PARTITION BY l_orderkey, pos ORDER BY l_extendedprice, l_linenumber, l_partkey) AS INTEGER) AS slot,
       o_orderstatus, o_totalprice, CAST(coalesce(n, 0) AS BIGINT) AS num_TEs
FROM t LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN c ON l_orderkey = k""")
def q_bucketed_ranks(spark, sf_dir):
    """J1, J5 and W1 on tables bucketed by the play: no exchange."""
    from huddle.sources.bucketed import with_play_and_ranks, write_bucketed
    from huddle.sources.readers import read_table
    from huddle.sources.standin import role_code
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    t = read_table(spark, sf_dir, "lineitem").select(*_ROW_ID, "l_extendedprice", role_code().alias("pos"))
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_totalprice")
    t = write_bucketed(t, ["l_orderkey"], buckets, ["pos"])
    o = write_bucketed(o, ["l_orderkey"], buckets)
    out = with_play_and_ranks(t, o, ["l_orderkey"], "pos", ["l_extendedprice", "l_linenumber", "l_partkey"], "TE")
    return out.drop("l_extendedprice")


@register("join_left_dim", """
SELECT o_orderkey, o_custkey, c_mktsegment, c_nationkey
FROM orders o LEFT JOIN customer c ON o_custkey = c_custkey""")
def q_join_left_dim(spark, sf_dir):
    """Plays LEFT games (a dimension, broadcast when it fits)."""
    from huddle.operators.joins import join_left
    from huddle.sources.readers import read_table
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer")
    return join_left(o, c, [("o_custkey", "c_custkey")]).select("o_orderkey", "o_custkey", "c_mktsegment",
                                                                "c_nationkey")


@register("merge_frames", FRAMES_SQL.replace("frames AS (", "", 1).rstrip().rstrip(")").replace(
    "SELECT l.*, o.*, c.*, p.p_name, p.p_brand,",
    "SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, c_mktsegment, p_name, p_brand,"))
def q_merge_frames(spark, sf_dir):
    """J1-J3 together: the stand-in of the tracking merge."""
    from huddle.functions.expressions import direction_label
    from huddle.operators.joins import merge_frames
    from huddle.sources.readers import read_table
    from huddle.sources.standin import role_code
    tables = [read_table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "part")]
    merged = merge_frames(*tables, play_on=[("l_orderkey", "o_orderkey")], game_on=[("o_custkey", "c_custkey")],
                          player_on=[("l_partkey", "p_partkey")])
    return merged.select(*_ROW_ID, "o_custkey", "c_mktsegment", "p_name", "p_brand", role_code().alias("pos"),
                         direction_label("o_orderpriority", DRIVER.left_tokens, DRIVER.right_tokens).alias("run_dir"))


@register("join_fanout_report", """
SELECT p_name, count(*) AS n_rows, min(p_partkey) AS min_id, max(p_partkey) AS max_id
FROM part GROUP BY p_name HAVING count(*) > 1""")
def q_join_fanout_report(spark, sf_dir):
    """Player names that match several player rows (each would duplicate
    every tracking row of that name in a name join, B9)."""
    from huddle.operators.joins import fanout_report
    from huddle.sources.readers import read_table
    return fanout_report(read_table(spark, sf_dir, "part"), "p_name", "p_partkey")


@register("join_left_name", """
WITH f AS (SELECT p.p_name AS name, count(*) AS fact_rows FROM lineitem l JOIN part p ON l_partkey = p_partkey
           GROUP BY p.p_name),
d AS (SELECT p_name, count(*) AS dim_rows FROM part GROUP BY p_name)
SELECT name, fact_rows, CAST(coalesce(dim_rows, 0) AS BIGINT) AS dim_rows,
       CAST(fact_rows * greatest(coalesce(dim_rows, 0), 1) AS BIGINT) AS joined_rows
FROM f LEFT JOIN d ON f.name = d.p_name""")
def q_join_left_name(spark, sf_dir):
    """J3 on a name, pre-aggregated: per name, the rows a left join on the
    name would produce.  The dimension is reduced to one row per name before
    joining, so nothing fans out."""
    from huddle.operators.joins import fanout_join_summary
    from huddle.sources.readers import read_table
    l = read_table(spark, sf_dir, "lineitem")
    p = read_table(spark, sf_dir, "part")
    facts = l.join(p.select("p_partkey", F.col("p_name").alias("name")), l.l_partkey == p.p_partkey)
    return fanout_join_summary(facts, p, "name", "p_name").drop("p_name")


@register("join_left_name_rows", """
WITH d AS (SELECT p_partkey AS player_id, p_name || ' ' || p_brand AS display_name, p_size FROM part),
f AS (SELECT l_orderkey, l_linenumber, l_partkey, display_name FROM lineitem l LEFT JOIN d ON l_partkey = player_id)
SELECT f.l_orderkey, f.l_linenumber, f.l_partkey, f.display_name, d.player_id, d.p_size
FROM f LEFT JOIN d ON f.display_name = d.display_name""")
def q_join_left_name_rows(spark, sf_dir):
    """J3, the joined rows themselves: tracking rows carry a player's name
    (of which there are several players) and match every player of that name;
    hot names are salted, whatever the size of the player table."""
    from huddle.operators.joins import skewed_join
    from huddle.sources.readers import read_table
    l = read_table(spark, sf_dir, "lineitem")
    players = read_table(spark, sf_dir, "part").select(
        F.concat("p_name", F.lit(" "), "p_brand").alias("display_name"), F.col("p_partkey").alias("player_id"), "p_size")
    facts = l.join(players, l.l_partkey == players.player_id, "left").select(*_ROW_ID, "display_name")
    return skewed_join(facts, players, ["display_name"], "left", _ROW_ID).select(
        *_ROW_ID, "display_name", "player_id", "p_size")


# --------------------------------------------------------------------------
# aggregates
# --------------------------------------------------------------------------
@register("avg_by_team", with_frames("""
SELECT c_mktsegment, round(avg(o_totalprice), 6) AS avg_yards FROM frames
WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY c_mktsegment"""))
def q_avg_by_team(spark, sf_dir):
    from huddle.operators.tendencies import avg_by_team
    return avg_by_team(_frames(spark, sf_dir, "customer"), DRIVER).withColumn("avg_yards", rnd("avg_yards"))


@register("avg_by_team_per_play", with_frames(f"""
p AS (SELECT {KEYS_SQL}, max(c_mktsegment) AS c_mktsegment, max(o_totalprice) AS o_totalprice FROM frames
      WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY {KEYS_SQL})
SELECT c_mktsegment, round(avg(o_totalprice), 6) AS avg_yards FROM p GROUP BY c_mktsegment"""))
def q_avg_by_team_per_play(spark, sf_dir):
    from huddle.operators.tendencies import avg_by_team_per_play
    return avg_by_team_per_play(_frames(spark, sf_dir, "customer"), DRIVER).withColumn("avg_yards", rnd("avg_yards"))


@register("avg_by_formation", with_frames("""
SELECT o_orderstatus, round(avg(o_totalprice), 6) AS avg_yards_lr FROM frames
WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL
  AND (o_orderpriority LIKE '%URGENT%' OR o_orderpriority LIKE '%HIGH%'
       OR o_orderpriority LIKE '%LOW%' OR o_orderpriority LIKE '%NOT%')
GROUP BY o_orderstatus"""))
def q_avg_by_formation(spark, sf_dir):
    from huddle.operators.frames import substring_or_filter
    from huddle.operators.tendencies import avg_by_formation
    rows = substring_or_filter(_frames(spark, sf_dir), DRIVER)
    return avg_by_formation(rows, DRIVER).withColumn("avg_yards_lr", rnd("avg_yards_lr"))


_ENTITY_ROWS_SQL = """
er AS (SELECT * FROM frames WHERE o_orderpriority IS NOT NULL
       AND regexp_matches(o_orderpriority, 'URGENT|HIGH|LOW|NOT') AND pos IN ('T','G','C','TE')
       AND o_totalprice IS NOT NULL)"""


def money_avg_sql(col: str) -> str:
    """Exact mean of a 2-decimal money column to 6 places, HALF_UP, as a
    double: integer cents summed, then integer division with rounding.
    Equals Spark's ``avg`` over ``decimal(18,2)`` (exact sum, HALF_UP)."""
    s = f"CAST(sum(CAST({col} AS DECIMAL(18,2))) * 100 AS HUGEINT)"
    return (f"(sign({s}) * ((2 * abs({s}) * 10000 + count({col})) // (2 * count({col}))) / 1000000.0)")


@register("avg_by_entity", with_frames(_ENTITY_ROWS_SQL + f"""
SELECT l_partkey, {money_avg_sql("o_totalprice")} AS avg_yards FROM er GROUP BY l_partkey"""))
def q_avg_by_entity(spark, sf_dir):
    """Mean outcome per player over left/right run rows.  The price is
    money: averaged as decimal(18,2), exact in any summation order."""
    from pyspark.sql.types import DecimalType

    from huddle.operators.frames import regex_filter
    from huddle.operators.tendencies import avg_by
    rows = regex_filter(_frames(spark, sf_dir), DRIVER, None, required=[DRIVER.outcome])
    rows = rows.withColumn(DRIVER.outcome, F.col(DRIVER.outcome).cast(DecimalType(18, 2)))
    return avg_by(rows, [DRIVER.entity], DRIVER.outcome).withColumn("avg_yards", F.col("avg_yards").cast("double"))


@register("distinct_segments", with_frames("""
SELECT DISTINCT c_mktsegment FROM frames"""))
def q_distinct_segments(spark, sf_dir):
    from huddle.operators.tendencies import distinct_segments
    return distinct_segments(_frames(spark, sf_dir, "customer"), DRIVER.team)


@register("first_attribute", with_frames("""
SELECT l_partkey, arg_min(p_name, (l_orderkey, l_linenumber)) AS p_name,
       arg_min(pos, (l_orderkey, l_linenumber)) AS pos, count(*) AS num_samples
FROM frames GROUP BY l_partkey"""))
def q_first_attribute(spark, sf_dir):
    """Name and role of each player's first row (by play, then line)."""
    from huddle.operators.tendencies import first_attribute
    return first_attribute(_frames(spark, sf_dir, "part"), [DRIVER.entity], [DRIVER.entity_name, "pos"],
                           ["l_orderkey", "l_linenumber"])


# --------------------------------------------------------------------------
# per-player side study and leaderboards
# --------------------------------------------------------------------------
_STUDY_SQL = f"""
sr AS (SELECT * FROM frames WHERE o_orderpriority IS NOT NULL
       AND regexp_matches(o_orderpriority, 'URGENT|HIGH|LOW|NOT') AND pos IN ('T','G','C','TE')
       AND {_REQ_SQL}),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY {KEYS_SQL}, pos ORDER BY {ORDER_SQL}) AS INTEGER) AS position_index FROM sr),
sl AS (SELECT *, CASE WHEN pos = 'T' AND position_index = 1 THEN 'LT' WHEN pos = 'T' AND position_index = 2 THEN 'RT'
                      WHEN pos = 'G' AND position_index = 1 THEN 'LG' WHEN pos = 'G' AND position_index = 2 THEN 'RG'
                      WHEN pos = 'C' THEN 'C' WHEN pos = 'TE' THEN 'TE' END AS true_position FROM rk),
cy AS (SELECT {KEYS_SQL}, min(l_extendedprice) AS center_y FROM sl WHERE pos = 'C' GROUP BY {KEYS_SQL}),
st AS (SELECT sl.*, sl.l_extendedprice - cy.center_y AS y_rel_C FROM sl
       LEFT JOIN cy ON sl.o_custkey = cy.o_custkey AND sl.l_orderkey = cy.l_orderkey
       WHERE sl.true_position IS NOT NULL),
pv AS (SELECT l_partkey, p_name, true_position,
         avg(CASE WHEN run_dir = 'left' THEN l_quantity END) AS left_dir,
         avg(CASE WHEN run_dir = 'left' THEN l_discount END) AS left_o,
         avg(CASE WHEN run_dir = 'left' THEN y_rel_C END) AS left_yrel,
         avg(CASE WHEN run_dir = 'right' THEN l_quantity END) AS right_dir,
         avg(CASE WHEN run_dir = 'right' THEN l_discount END) AS right_o,
         avg(CASE WHEN run_dir = 'right' THEN y_rel_C END) AS right_yrel
       FROM st GROUP BY l_partkey, p_name, true_position),
df AS (SELECT *, abs(left_dir - right_dir) AS dir_diff, abs(left_o - right_o) AS o_diff,
              abs(left_yrel - right_yrel) AS yrel_diff FROM pv),
dt AS (SELECT *, dir_diff + o_diff + yrel_diff AS total_diff FROM df)"""

_SIDE_COLS = ["left_dir", "left_o", "left_yrel", "right_dir", "right_o", "right_yrel"]
_DIFF_COLS = ["dir_diff", "o_diff", "yrel_diff", "total_diff"]


def _study_diff(spark, sf_dir):
    from huddle.plans.study import side_tendencies, study_rows
    return side_tendencies(study_rows(_frames(spark, sf_dir, "part"), DRIVER, None), DRIVER)


def _round_all(df, cols):
    return df.select(*[rnd(c).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("pivot_sides", with_frames(_STUDY_SQL + """
SELECT l_partkey, p_name, true_position, """ + ", ".join(f"round({c}, 6) AS {c}" for c in _SIDE_COLS) + " FROM pv"))
def q_pivot_sides(spark, sf_dir):
    """G7 + G10: per player and slot, mean measures on left and right runs."""
    from huddle.operators.pivot import pivot_sides
    from huddle.plans.study import study_rows
    rows = study_rows(_frames(spark, sf_dir, "part"), DRIVER, None)
    piv = pivot_sides(rows, [DRIVER.entity, DRIVER.entity_name, "true_position"], DRIVER.label,
                      {"dir": DRIVER.heading, "o": DRIVER.facing, "yrel": "y_rel_C"})
    return _round_all(piv, _SIDE_COLS)


@register("avg_by_entity_side", with_frames(_STUDY_SQL + f"""
SELECT l_partkey, p_name, true_position, run_dir, round(avg(l_quantity), 6) AS avg_dir,
       round(avg(l_discount), 6) AS avg_o, round(avg(y_rel_C), 6) AS avg_yrel
FROM st GROUP BY l_partkey, p_name, true_position, run_dir"""))
def q_avg_by_entity_side(spark, sf_dir):
    """G7 as its own table: one row per player, slot and side."""
    from huddle.operators.tendencies import avg_by
    from huddle.plans.study import study_rows
    rows = study_rows(_frames(spark, sf_dir, "part"), DRIVER, None)
    g = [DRIVER.entity, DRIVER.entity_name, "true_position", DRIVER.label]
    out = rows.groupBy(*g).agg(F.avg(DRIVER.heading).alias("avg_dir"), F.avg(DRIVER.facing).alias("avg_o"),
                               F.avg("y_rel_C").alias("avg_yrel"))
    return _round_all(out, ["avg_dir", "avg_o", "avg_yrel"])


@register("side_difference", with_frames(_STUDY_SQL + """
SELECT l_partkey, p_name, true_position, """ + ", ".join(f"round({c}, 6) AS {c}" for c in _SIDE_COLS + _DIFF_COLS)
    + " FROM dt"))
def q_side_difference(spark, sf_dir):
    return _round_all(_study_diff(spark, sf_dir), _SIDE_COLS + _DIFF_COLS)


@register("leaderboard_total", with_frames(_STUDY_SQL + """
SELECT l_partkey, p_name, true_position, """ + ", ".join(f"round({c}, 6) AS {c}" for c in _DIFF_COLS)
    + " FROM dt ORDER BY total_diff DESC NULLS LAST, l_partkey, true_position LIMIT 20"))
def q_leaderboard_total(spark, sf_dir):
    """The 20 players with the largest total side difference."""
    from huddle.operators.tendencies import leaderboard_total
    top = leaderboard_total(_study_diff(spark, sf_dir), [DRIVER.entity, "true_position"], 20)
    return _round_all(top.select(DRIVER.entity, DRIVER.entity_name, "true_position", *_DIFF_COLS), _DIFF_COLS)


@register("leaderboard_by_feature", with_frames(_STUDY_SQL + """,
lg AS (SELECT l_partkey, p_name, true_position, 'dir_diff' AS feature, dir_diff AS value FROM dt
       UNION ALL SELECT l_partkey, p_name, true_position, 'o_diff', o_diff FROM dt
       UNION ALL SELECT l_partkey, p_name, true_position, 'yrel_diff', yrel_diff FROM dt),
rkd AS (SELECT *, CAST(row_number() OVER (PARTITION BY feature ORDER BY value DESC NULLS LAST,
                                     l_partkey, p_name, true_position) AS INTEGER) AS rank FROM lg)
SELECT l_partkey, p_name, true_position, feature, round(value, 6) AS value, rank FROM rkd WHERE rank <= 10"""))
def q_leaderboard_by_feature(spark, sf_dir):
    """Top 10 players of each difference feature."""
    from huddle.operators.tendencies import leaderboard_by_feature
    from huddle.plans.study import DIFF_FEATURES
    d = _study_diff(spark, sf_dir).select(DRIVER.entity, DRIVER.entity_name, "true_position", *DIFF_FEATURES)
    out = leaderboard_by_feature(d, [DRIVER.entity, DRIVER.entity_name, "true_position"], DIFF_FEATURES, 10)
    return out.withColumn("value", rnd("value"))


# --------------------------------------------------------------------------
# ordered frames: the frame before an event
# --------------------------------------------------------------------------
@register("frame_before_event", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_no FROM events),
s AS (SELECT user_id, max(frame_no) AS m FROM n WHERE event_type = 'purchase' GROUP BY user_id)
SELECT n.user_id, n.frame_no, n.event_id, n.event_type, n.value
FROM n JOIN s ON n.user_id = s.user_id AND n.frame_no = s.m - 1""")
def q_frame_before_event(spark, sf_dir):
    """J7 on the events stream: each user's row just before their last
    purchase, with its 1-based position in the user's order."""
    from huddle.operators.frames import previous_row_before_last
    from huddle.sources.standin import driver_events
    ev = driver_events(spark, sf_dir)
    out = previous_row_before_last(ev, "user_id", ["ts", "event_id"], "event_type", "purchase",
                                   carry=["event_type", "value"])
    return out.select("user_id", "frame_no", "event_id", "event_type", "value")


@register("frame_before_event_offset", """
WITH s AS (SELECT l_orderkey, max(l_linenumber) - 1 AS w FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_returnflag
FROM lineitem l JOIN s ON l.l_orderkey = s.l_orderkey AND l.l_linenumber = s.w""")
def q_frame_before_event_offset(spark, sf_dir):
    """J7 with integer frames, the reference's ``frame == last event frame - 1``
    equi-join: play = order, frame = line number, event = a returned line."""
    from huddle.operators.frames import frame_before_event
    from huddle.sources.readers import read_table
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return frame_before_event(li, ["l_orderkey"], "l_linenumber", "l_returnflag", "R")


# --------------------------------------------------------------------------
# sources
# --------------------------------------------------------------------------
@register("scan_parquet", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM lineitem WHERE l_quantity > 45""")
def q_scan_parquet(spark, sf_dir):
    """S4 with a projection and a filter that reach the scan (ReadSchema,
    PushedFilters)."""
    from huddle.sources.readers import read_table
    return (read_table(spark, sf_dir, "lineitem")
            .select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
            .filter(F.col("l_quantity") > 45))


@register("scan_union_parts", """
SELECT o_orderkey, o_custkey, o_totalprice, NULL::VARCHAR AS c_mktsegment FROM orders
UNION ALL SELECT NULL::BIGINT, c_custkey, NULL::DOUBLE, c_mktsegment FROM customer""")
def q_scan_union_parts(spark, sf_dir):
    """Parts with different columns unioned by name (missing -> null)."""
    from huddle.sources.readers import read_table, union_parts
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return union_parts([o, c]).select("o_orderkey", "o_custkey", "o_totalprice", "c_mktsegment")


@register("normalize_nulls", """
SELECT event_id, CASE WHEN event_type IN ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan',
  '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null', 'error') THEN NULL
  ELSE event_type END AS event_type,
  CASE WHEN isnan(value) THEN NULL ELSE value END AS value FROM events""")
def q_normalize_nulls(spark, sf_dir):
    """Missing-value tokens (pandas' list plus a table-specific one,
    'error') become null; NaN becomes null."""
    from huddle.functions.expressions import PANDAS_NA_TOKENS
    from huddle.sources.readers import normalize_nulls, read_table
    ev = read_table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return normalize_nulls(ev, tuple(PANDAS_NA_TOKENS) + ("error",))


@register("repartition_preserves_rows", with_frames(f"""
SELECT {KEYS_SQL}, count(*) AS n_rows, count(DISTINCT l_partkey) AS n_players FROM frames GROUP BY {KEYS_SQL}"""))
def q_repartition_preserves_rows(spark, sf_dir):
    """The merged rows clustered by play (a rebalance on the play keys,
    which AQE splits where a play is hot, instead of round-robin); rows per
    play are unchanged."""
    f = _frames(spark, sf_dir).hint("rebalance", *DRIVER.keys)
    return f.groupBy(*DRIVER.keys).agg(F.count(F.lit(1)).alias("n_rows"),
                                       F.countDistinct("l_partkey").alias("n_players"))


# --------------------------------------------------------------------------
# evaluation on the scored fixture
# --------------------------------------------------------------------------
_SCORED_SQL = """
sc AS (SELECT *, run_dir AS label, CASE WHEN l_quantity <= 25.0 THEN 'left' ELSE 'right' END AS prediction
       FROM frames WHERE run_dir IN ('left', 'right'))"""


def _scored(spark, sf_dir, *dimensions):
    from huddle.plans.scored import scored_rows
    return scored_rows(_frames(spark, sf_dir, *dimensions), DRIVER)


def _acc_sql(seg: str, min_rows: int = 0) -> str:
    having = f" HAVING count(*) >= {min_rows}" if min_rows else ""
    return (f"SELECT {seg}, count(*) AS n, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) "
            f"AS accuracy FROM sc GROUP BY {seg}{having}")


@register("accuracy_by_segment", with_frames(_SCORED_SQL + "\n" + _acc_sql("c_mktsegment")))
def q_accuracy_by_segment(spark, sf_dir):
    from huddle.operators.evaluate import accuracy_by_segment
    return accuracy_by_segment(_scored(spark, sf_dir, "customer"), DRIVER.team).withColumn("accuracy", rnd("accuracy"))


@register("rank_segments", with_frames(_SCORED_SQL + "\n" + _acc_sql("o_orderstatus") + " ORDER BY accuracy DESC"))
def q_rank_segments(spark, sf_dir):
    from huddle.operators.evaluate import accuracy_by_segment, rank_segments
    acc = accuracy_by_segment(_scored(spark, sf_dir), DRIVER.formation).withColumn("accuracy", rnd("accuracy"))
    return rank_segments(acc, "accuracy", [DRIVER.formation])


@register("confusion_matrix", with_frames(_SCORED_SQL + """
SELECT label, count(CASE WHEN prediction = 'left' THEN 1 END) AS pred_left,
       count(CASE WHEN prediction = 'right' THEN 1 END) AS pred_right FROM sc GROUP BY label"""))
def q_confusion_matrix(spark, sf_dir):
    from huddle.operators.evaluate import confusion_matrix
    return confusion_matrix(_scored(spark, sf_dir), ["left", "right"])


@register("classification_report", with_frames(_SCORED_SQL + """,
c AS (SELECT count(*) AS n, sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS hits,
        count(CASE WHEN label = 'left' AND prediction = 'left' THEN 1 END) AS tp0,
        count(CASE WHEN prediction = 'left' THEN 1 END) AS pp0, count(CASE WHEN label = 'left' THEN 1 END) AS s0,
        count(CASE WHEN label = 'right' AND prediction = 'right' THEN 1 END) AS tp1,
        count(CASE WHEN prediction = 'right' THEN 1 END) AS pp1, count(CASE WHEN label = 'right' THEN 1 END) AS s1
      FROM sc),
pc AS (SELECT 'left' AS class, tp0 / pp0 AS precision, tp0 / s0 AS recall, s0 AS support FROM c
       UNION ALL SELECT 'right', tp1 / pp1, tp1 / s1, s1 FROM c),
pf AS (SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM pc),
al AS (SELECT class, precision, recall, f1, CAST(support AS BIGINT) AS support FROM pf
       UNION ALL SELECT 'accuracy', NULL, NULL, (SELECT hits / n FROM c), (SELECT n FROM c)
       UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM pf
       UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                        sum(f1 * support) / sum(support), sum(support) FROM pf)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM al"""))
def q_classification_report(spark, sf_dir):
    from huddle.operators.evaluate import classification_report
    rep = classification_report(_scored(spark, sf_dir), ["left", "right"])
    return _round_all(rep, ["precision", "recall", "f1"])


_ENTITY_ACC_SQL = _SCORED_SQL + """,
ea AS (SELECT l_partkey, count(*) AS n, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy
       FROM sc GROUP BY l_partkey HAVING count(*) >= 20)"""


@register("top_bottom_entities", with_frames(_ENTITY_ACC_SQL + """,
t AS (SELECT l_partkey, n, accuracy, 'top' AS "end" FROM ea ORDER BY accuracy DESC, l_partkey LIMIT 10),
b AS (SELECT l_partkey, n, accuracy, 'bottom' AS "end" FROM ea ORDER BY accuracy ASC, l_partkey LIMIT 10)
SELECT l_partkey, n, round(accuracy, 6) AS accuracy, "end" FROM (SELECT * FROM t UNION ALL SELECT * FROM b)"""))
def q_top_bottom_entities(spark, sf_dir):
    """T5: the ten most and ten least predictable players (20+ rows)."""
    from huddle.operators.evaluate import accuracy_by_segment
    from huddle.operators.tendencies import top_bottom
    acc = accuracy_by_segment(_scored(spark, sf_dir), DRIVER.entity, min_rows=20)
    return top_bottom(acc, "accuracy", [DRIVER.entity], 10).withColumn("accuracy", rnd("accuracy"))


@register("top_bottom_union", with_frames(_SCORED_SQL + """,
ta AS (SELECT c_mktsegment, count(*) AS n, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy
       FROM sc GROUP BY c_mktsegment),
t AS (SELECT *, 'top' AS "end" FROM ta ORDER BY accuracy DESC, c_mktsegment LIMIT 3),
b AS (SELECT *, 'bottom' AS "end" FROM ta ORDER BY accuracy ASC, c_mktsegment LIMIT 3)
SELECT c_mktsegment, n, round(accuracy, 6) AS accuracy, "end" FROM (SELECT * FROM t UNION ALL SELECT * FROM b)"""))
def q_top_bottom_union(spark, sf_dir):
    """Top 3 and bottom 3 teams concatenated (5 teams: one repeats)."""
    from huddle.operators.evaluate import accuracy_by_segment
    from huddle.operators.tendencies import top_bottom
    acc = accuracy_by_segment(_scored(spark, sf_dir, "customer"), DRIVER.team)
    return top_bottom(acc, "accuracy", [DRIVER.team], 3).withColumn("accuracy", rnd("accuracy"))


def _rules_sql() -> str:
    from huddle.plans.scored import RULES
    parts = [f"SELECT '{n}' AS family, {i} AS order_idx, avg(CASE WHEN (CASE WHEN l_quantity <= {t} THEN 'left' "
             f"ELSE 'right' END) = run_dir THEN 1.0 ELSE 0.0 END) AS accuracy FROM frames "
             f"WHERE run_dir IN ('left', 'right')" for i, (n, t) in enumerate(RULES)]
    return " UNION ALL ".join(parts)


@register("best_model", with_frames(f"""
r AS ({_rules_sql()})
SELECT family, order_idx, round(accuracy, 6) AS accuracy FROM r
ORDER BY accuracy DESC, order_idx ASC LIMIT 1"""))
def q_best_model(spark, sf_dir):
    """The best of several candidate predictors by accuracy, earlier
    wins ties; the candidates are fixed threshold rules scored on the data."""
    from huddle.operators.evaluate import best_of, hit
    from huddle.plans.scored import RULES
    f = _frames(spark, sf_dir).filter(F.col(DRIVER.label).isin("left", "right"))
    aggs = [F.avg(F.when((F.when(F.col(DRIVER.heading) <= t, "left").otherwise("right")) == F.col(DRIVER.label),
                         1.0).otherwise(0.0)).alias(n) for n, t in RULES]
    wide = f.agg(*aggs)
    stacked = wide.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("family"), F.lit(i).alias("order_idx"), F.col(n).alias("accuracy"))
        for i, (n, _) in enumerate(RULES)])).alias("r")).select("r.*")
    return best_of(stacked, "family", "accuracy", "order_idx").withColumn("accuracy", rnd("accuracy"))


# --------------------------------------------------------------------------
# regression of outcome on predictability
# --------------------------------------------------------------------------
_OLS_COLS = ["intercept", "slope", "se_intercept", "se_slope", "t_intercept", "t_slope", "r2", "adj_r2", "f_stat"]


def _ols_select_sql(src: str, x: str, y: str, group: str = "", min_rows: int = 0) -> str:
    g = f"{group}, " if group else ""
    having = f" HAVING regr_count({y}, {x}) >= {min_rows}" if min_rows else ""
    gb = f" GROUP BY {group}" if group else ""
    return f"""
agg AS (SELECT {g}regr_count({y}, {x}) AS n, regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept,
          regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy, regr_avgx({y}, {x}) AS avgx
        FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL{gb}{having}),
d AS (SELECT *, CASE WHEN n > 2 THEN (syy - sxy * sxy / sxx) / (n - 2) END AS s2,
             CASE WHEN syy > 0 THEN sxy * sxy / (sxx * syy) END AS r2 FROM agg),
e AS (SELECT *, sqrt(s2 / sxx) AS se_slope, sqrt(s2 * (1.0 / n + avgx * avgx / sxx)) AS se_intercept FROM d)
SELECT {g}CAST(n AS BIGINT) AS n, round(intercept, 4) AS intercept, round(slope, 4) AS slope,
  round(se_intercept, 4) AS se_intercept, round(se_slope, 4) AS se_slope,
  round(intercept / se_intercept, 4) AS t_intercept, round(slope / se_slope, 4) AS t_slope,
  round(r2, 4) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 2), 4) AS adj_r2,
  round(r2 / (1 - r2) * (n - 2), 4) AS f_stat FROM e"""


_TEAM_METRICS_SQL = _SCORED_SQL + """,
ay AS (SELECT c_mktsegment, avg(o_totalprice) AS avg_yards FROM frames
       WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY c_mktsegment),
ac AS (SELECT c_mktsegment, count(*) AS n, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy
       FROM sc GROUP BY c_mktsegment),
tm AS (SELECT ay.c_mktsegment, ay.avg_yards, ac.accuracy, ac.n FROM ay JOIN ac ON ay.c_mktsegment = ac.c_mktsegment)"""


def _team_metrics(spark, sf_dir):
    from huddle.operators.evaluate import accuracy_by_segment
    from huddle.operators.joins import join_metrics
    from huddle.operators.tendencies import avg_by_team
    f = _frames(spark, sf_dir, "customer")
    from huddle.plans.scored import scored_rows
    acc = accuracy_by_segment(scored_rows(f, DRIVER), DRIVER.team)
    return join_metrics(avg_by_team(f, DRIVER), acc, DRIVER.team)


@register("join_metric_accuracy", with_frames(_TEAM_METRICS_SQL + """
SELECT c_mktsegment, round(avg_yards, 6) AS avg_yards, round(accuracy, 6) AS accuracy, n FROM tm"""))
def q_join_metric_accuracy(spark, sf_dir):
    """Per team, mean outcome beside model accuracy."""
    return _round_all(_team_metrics(spark, sf_dir), ["avg_yards", "accuracy"])


@register("ols_overall", with_frames(_TEAM_METRICS_SQL + "," + _ols_select_sql("tm", "accuracy", "avg_yards")))
def q_ols_overall(spark, sf_dir):
    """OLS of mean outcome on accuracy over teams."""
    from huddle.operators.regress import ols
    out = ols(_team_metrics(spark, sf_dir), "accuracy", "avg_yards")
    return out.select("n", *[rnd(c, 4).alias(c) for c in _OLS_COLS])


_ENTITY_TABLE_SQL = _ENTITY_ACC_SQL + """,
""" + _ENTITY_ROWS_SQL.strip() + """,
ey AS (SELECT l_partkey, avg(o_totalprice) AS avg_yards FROM er GROUP BY l_partkey),
ep AS (SELECT l_partkey, arg_min(pos, (l_orderkey, l_linenumber)) AS pos FROM sc GROUP BY l_partkey),
et AS (SELECT ea.l_partkey, ep.pos, ea.accuracy, ey.avg_yards FROM ea JOIN ey ON ea.l_partkey = ey.l_partkey
       JOIN ep ON ea.l_partkey = ep.l_partkey)"""


def _entity_table(spark, sf_dir):
    from huddle.operators.evaluate import accuracy_by_segment
    from huddle.operators.frames import regex_filter
    from huddle.operators.joins import join_metrics
    from huddle.operators.tendencies import avg_by, first_attribute
    f = _frames(spark, sf_dir)
    from huddle.plans.scored import scored_rows
    sc = scored_rows(f, DRIVER)
    acc = accuracy_by_segment(sc, DRIVER.entity, min_rows=20).drop("n")
    yards = avg_by(regex_filter(f, DRIVER, None, required=[DRIVER.outcome]), [DRIVER.entity], DRIVER.outcome)
    pos = first_attribute(sc, [DRIVER.entity], ["pos"], ["l_orderkey", "l_linenumber"]).drop("num_samples")
    return acc.join(yards, DRIVER.entity).join(pos, DRIVER.entity)


@register("ols_by_group", with_frames(_ENTITY_TABLE_SQL + "," + _ols_select_sql("et", "accuracy", "avg_yards",
                                                                                "pos", 10)))
def q_ols_by_group(spark, sf_dir):
    """OLS over players, one fit per role (groups of 10+), all in one
    aggregate job."""
    from huddle.operators.regress import ols
    out = ols(_entity_table(spark, sf_dir), "accuracy", "avg_yards", ["pos"], min_rows=10)
    return out.select("pos", "n", *[rnd(c, 4).alias(c) for c in _OLS_COLS])


@register("ols_summary")
def q_ols_summary(spark, sf_dir):
    """The whole OLS summary per role, with p-values and intervals (no
    SQL twin: SQL has no Student-t distribution; see ``ols_diagnostics``)."""
    from huddle.operators.regress import ols_summary
    return ols_summary(_entity_table(spark, sf_dir), "accuracy", "avg_yards", ["pos"], min_rows=10, order=["l_partkey"])


_DIAGNOSTICS = ("log_likelihood", "aic", "bic", "skew", "kurtosis", "omnibus", "prob_omnibus", "jarque_bera", "prob_jb",
                "durbin_watson", "cond_no")


@register("ols_diagnostics", with_frames(_ENTITY_TABLE_SQL + """,
agg AS (SELECT pos, count(*) AS n, regr_slope(avg_yards, accuracy) AS slope, regr_intercept(avg_yards, accuracy) AS intercept
        FROM et WHERE accuracy IS NOT NULL AND avg_yards IS NOT NULL GROUP BY pos HAVING count(*) >= 10),
r AS (SELECT et.pos, l_partkey, accuracy AS x, avg_yards - intercept - slope * accuracy AS e
      FROM et JOIN agg ON et.pos = agg.pos WHERE accuracy IS NOT NULL AND avg_yards IS NOT NULL),
l AS (SELECT *, e - lag(e) OVER (PARTITION BY pos ORDER BY l_partkey) AS d, e - avg(e) OVER (PARTITION BY pos) AS c FROM r),
m AS (SELECT pos, CAST(count(*) AS DOUBLE) AS n, avg(e * e) AS m2, avg(c * c) AS c2, avg(c * c * c) AS c3, avg(c * c * c * c) AS c4,
             sum(d * d) / sum(e * e) AS durbin_watson, avg(x) AS x1, avg(x * x) AS x2 FROM l GROUP BY pos),
s AS (SELECT *, c3 / pow(c2, 1.5) AS skew, c4 / (c2 * c2) AS kurtosis, -n / 2 * (ln(2 * pi()) + ln(m2) + 1) AS ll,
             sqrt(pow((1 - x2) / 2, 2) + x1 * x1) AS root, (1 + x2) / 2 AS half,
             sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
             6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b1
      FROM m),
z AS (SELECT *, skew * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) / sqrt(2 / (w2 - 1)) AS u,
             6 + 8 / b1 * (2 / b1 + sqrt(1 + 4 / (b1 * b1))) AS a,
             (kurtosis - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS kx
      FROM s),
o AS (SELECT *, pow(asinh(u) / sqrt(0.5 * ln(w2)), 2)
               + pow((1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + kx * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)), 2) AS omnibus FROM z)
SELECT pos, CAST(n - 2 AS BIGINT) AS df_resid, round(ll, 4) AS log_likelihood, round(4 - 2 * ll, 4) AS aic,
  round(2 * ln(n) - 2 * ll, 4) AS bic, round(skew, 4) AS skew, round(kurtosis, 4) AS kurtosis, round(omnibus, 4) AS omnibus,
  round(exp(-omnibus / 2), 4) AS prob_omnibus, round(n / 6 * (skew * skew + pow(kurtosis - 3, 2) / 4), 4) AS jarque_bera,
  round(exp(-n / 12 * (skew * skew + pow(kurtosis - 3, 2) / 4)), 4) AS prob_jb, round(durbin_watson, 4) AS durbin_watson,
  round(sqrt((half + root) / ((x2 - x1 * x1) / (half + root))), 4) AS cond_no FROM o"""))
def q_ols_diagnostics(spark, sf_dir):
    """Residual tests, likelihood, criteria and condition number per role,
    the residuals in order of the player."""
    from huddle.operators.regress import ols_diagnostics
    out = ols_diagnostics(_entity_table(spark, sf_dir), "accuracy", "avg_yards", ["l_partkey"], ["pos"], min_rows=10)
    return out.select("pos", "df_resid", *[rnd(c, 4).alias(c) for c in _DIAGNOSTICS])


@register("fitted_values", with_frames(_TEAM_METRICS_SQL + """,
cf AS (SELECT regr_intercept(avg_yards, accuracy) AS a, regr_slope(avg_yards, accuracy) AS b FROM tm)
SELECT c_mktsegment, round(accuracy, 6) AS accuracy, round(avg_yards, 6) AS avg_yards,
       round(a + b * accuracy, 4) AS fitted FROM tm, cf"""))
def q_fitted_values(spark, sf_dir):
    """The fitted line at every team's accuracy."""
    from huddle.operators.regress import fitted_values, ols
    tm = _team_metrics(spark, sf_dir)
    fit = fitted_values(tm, ols(tm, "accuracy", "avg_yards"), "accuracy")
    return fit.select(DRIVER.team, rnd("accuracy").alias("accuracy"), rnd("avg_yards").alias("avg_yards"),
                      rnd("fitted", 4).alias("fitted"))


# --------------------------------------------------------------------------
# encoding and split
# --------------------------------------------------------------------------
@register("label_encode", _wide_sql(FULL_SLOTS, True).replace(
    "SELECT * FROM o WHERE",
    "SELECT o_custkey, l_orderkey, run_dir, CAST(dense_rank() OVER (ORDER BY run_dir) - 1 AS DOUBLE) AS label_idx "
    "FROM o WHERE"))
def q_label_encode(spark, sf_dir):
    """M1: alphabetical label codes (left 0, right 1) on the wide rows."""
    from huddle.operators.models import label_encoder
    wide = q_wide_features(spark, sf_dir)
    enc = label_encoder("run_dir").fit(wide)
    return enc.transform(wide).select("o_custkey", "l_orderkey", "run_dir", "label_idx")


@register("train_test_split", _wide_sql(FULL_SLOTS, True).replace(
    "SELECT * FROM o WHERE",
    "SELECT o_custkey, l_orderkey, CASE WHEN CAST('0x' || substr(md5('42:' || o_custkey || ':' || l_orderkey), 1, 8) "
    "AS UBIGINT) % 100 < 75 THEN 'train' ELSE 'test' END AS split FROM o WHERE"))
def q_train_test_split(spark, sf_dir):
    """M2: 75/25 split by a hash of the play key, seed 42."""
    from huddle.operators.models import with_split
    return with_split(q_wide_features(spark, sf_dir), DRIVER.keys).select("o_custkey", "l_orderkey", "split")


# --------------------------------------------------------------------------
# learning operators (rows-only checks: fitted models have no SQL twin)
# --------------------------------------------------------------------------
# Segment minimum for the stand-in: the driver tables give a few hundred
# complete plays at sf0.01, so the reference's 100 (teams) would leave no
# segment; 50 keeps every segment of that scale in play.
STANDIN_MIN_SEGMENT = 50
STANDIN_MIN_PLAYER = 20


def _model_table(spark, sf_dir):
    from huddle.plans.modeling import model_table
    return model_table(q_wide_features(spark, sf_dir), DRIVER)


@register("assemble_features")
def q_assemble_features(spark, sf_dir):
    """Feature vectors of the wide rows (keys, label, attributes dropped)."""
    from huddle.plans.modeling import assembled
    return assembled(_model_table(spark, sf_dir), DRIVER)


@register("segment_model_role_count")
def q_segment_model_role_count(spark, sf_dir):
    """M3: forest per TE count (1, 2)."""
    from huddle.plans.modeling import by_role_count
    return by_role_count(spark, _model_table(spark, sf_dir), DRIVER, STANDIN_MIN_SEGMENT)


@register("segment_model_team")
def q_segment_model_team(spark, sf_dir):
    """M4: forest per team."""
    from huddle.plans.modeling import by_segment
    return by_segment(spark, _model_table(spark, sf_dir), DRIVER, DRIVER.team, STANDIN_MIN_SEGMENT)


@register("segment_model_formation")
def q_segment_model_formation(spark, sf_dir):
    """M5: forest per formation."""
    from huddle.plans.modeling import by_segment
    return by_segment(spark, _model_table(spark, sf_dir), DRIVER, DRIVER.formation, STANDIN_MIN_SEGMENT)


@register("segment_confusion")
def q_segment_confusion(spark, sf_dir):
    """M8 of every fitted team model: held-out rows by true and predicted side."""
    from huddle.plans.modeling import segment_reports
    return segment_reports(_model_table(spark, sf_dir), DRIVER, DRIVER.team, STANDIN_MIN_SEGMENT)[0]


@register("segment_importances")
def q_segment_importances(spark, sf_dir):
    """M10 of every fitted team model: its ten most important features."""
    from huddle.plans.modeling import segment_reports
    return segment_reports(_model_table(spark, sf_dir), DRIVER, DRIVER.team, STANDIN_MIN_SEGMENT)[1]


@register("stratified_folds", """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%URGENT%' OR o_orderpriority LIKE '%HIGH%' THEN 'left'
                                   WHEN o_orderpriority LIKE '%LOW%' OR o_orderpriority LIKE '%NOT%' THEN 'right' END AS run_dir
           FROM orders),
h AS (SELECT *, CAST('0x' || substr(md5('43:' || o_orderkey), 1, 8) AS UBIGINT) AS hash FROM o)
SELECT o_orderkey, run_dir,
       CAST((row_number() OVER (PARTITION BY run_dir ORDER BY hash, o_orderkey) - 1) % 3 AS INTEGER) AS fold FROM h""")
def q_stratified_folds(spark, sf_dir):
    """Three exact stratified folds of all plays by side (plays
    without a side are a class of their own)."""
    from huddle.operators.folds import stratified_folds
    return stratified_folds(q_direction_label(spark, sf_dir), "run_dir", ["o_orderkey"], 3)


def _line_model_table(spark, sf_dir):
    from huddle.plans.modeling import model_table
    return model_table(q_wide_features_line_only(spark, sf_dir), DRIVER, LINE_SLOTS)


@register("grid_search_xgboost")
def q_grid_search_xgboost(spark, sf_dir):
    """The second-order boosted family, 3 stratified folds over rounds x
    depth x rate, on the five-slot table, with 100 and 200 rounds."""
    from huddle.plans.modeling import compare_boosted
    return compare_boosted(spark, _line_model_table(spark, sf_dir), DRIVER)


@register("tuned_forest")
def q_tuned_forest(spark, sf_dir):
    """A model-based sampler over the forest's five parameters, on the
    five-slot table: 50 trials (the first 10 at random) of 50 to 300 trees."""
    from huddle.plans.modeling import tune_by_model
    return tune_by_model(spark, _line_model_table(spark, sf_dir), DRIVER)


@register("grid_search_forest")
def q_grid_search_forest(spark, sf_dir):
    """3-fold grid over trees x depth."""
    from huddle.plans.modeling import compare_families
    return compare_families(spark, _model_table(spark, sf_dir), DRIVER, ["RandomForest"])


@register("grid_search_boosted")
def q_grid_search_boosted(spark, sf_dir):
    """3-fold grid over rounds x rate x depth of boosted trees."""
    from huddle.plans.modeling import compare_families
    return compare_families(spark, _model_table(spark, sf_dir), DRIVER, ["GradientBoosting"])


@register("grid_search_logistic")
def q_grid_search_logistic(spark, sf_dir):
    """3-fold grid over the inverse regularisation strength."""
    from huddle.plans.modeling import compare_families
    return compare_families(spark, _model_table(spark, sf_dir), DRIVER, ["LogReg"])


@register("random_search")
def q_random_search(spark, sf_dir):
    """50 seeded random trials over the tuned-forest space."""
    from huddle.plans.modeling import tune_forest
    return tune_forest(spark, _model_table(spark, sf_dir), DRIVER, 50)


@register("top_importances")
def q_top_importances(spark, sf_dir):
    """The ten largest feature importances of the forest."""
    from huddle.plans.modeling import importances
    return importances(spark, _model_table(spark, sf_dir), DRIVER, 10)


@register("entity_model")
def q_entity_model(spark, sf_dir):
    """M6: a 100-tree depth-5 bagged classifier per player with 20+ rows, in one
    grouped job."""
    from huddle.operators.entity_models import entity_models
    from huddle.plans.study import player_rows, study_rows
    rows = player_rows(study_rows(_frames(spark, sf_dir, "part"), DRIVER, None), DRIVER)
    return entity_models(spark, rows, DRIVER.entity, ["l_quantity", "l_discount", "y_rel_C", "dir_o"],
                         DRIVER.label, [*DRIVER.keys, *DRIVER.tiebreak], min_rows=STANDIN_MIN_PLAYER)


_FORM_METRICS_SQL = _SCORED_SQL + """,
fy AS (SELECT o_orderstatus, avg(o_totalprice) AS avg_yards_lr FROM frames
       WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL
         AND (o_orderpriority LIKE '%URGENT%' OR o_orderpriority LIKE '%HIGH%'
              OR o_orderpriority LIKE '%LOW%' OR o_orderpriority LIKE '%NOT%')
       GROUP BY o_orderstatus),
fa AS (SELECT o_orderstatus, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy
       FROM sc GROUP BY o_orderstatus),
fm AS (SELECT fy.o_orderstatus, fy.avg_yards_lr, fa.accuracy FROM fy JOIN fa ON fy.o_orderstatus = fa.o_orderstatus)"""


@register("ols_formation", with_frames(_FORM_METRICS_SQL + "," + _ols_select_sql("fm", "accuracy", "avg_yards_lr")))
def q_ols_formation(spark, sf_dir):
    """M17 (+ J9): OLS of mean outcome on left/right runs on accuracy, over formations."""
    from huddle.operators.evaluate import accuracy_by_segment
    from huddle.operators.frames import substring_or_filter
    from huddle.operators.joins import join_metrics
    from huddle.operators.regress import ols
    from huddle.operators.tendencies import avg_by
    from huddle.plans.scored import scored_rows
    f = _frames(spark, sf_dir)
    yards = avg_by(substring_or_filter(f, DRIVER), [DRIVER.formation], DRIVER.outcome, "avg_yards_lr")
    acc = accuracy_by_segment(scored_rows(f, DRIVER), DRIVER.formation).drop("n")
    out = ols(join_metrics(yards, acc, DRIVER.formation), "accuracy", "avg_yards_lr")
    return out.select("n", *[rnd(c, 4).alias(c) for c in _OLS_COLS])


@register("ols_players", with_frames(_ENTITY_TABLE_SQL + "," + _ols_select_sql("et", "accuracy", "avg_yards")))
def q_ols_players(spark, sf_dir):
    """M18 (+ J10): OLS of mean outcome on accuracy over all players (20+ rows)."""
    from huddle.operators.regress import ols
    out = ols(_entity_table(spark, sf_dir), "accuracy", "avg_yards")
    return out.select("n", *[rnd(c, 4).alias(c) for c in _OLS_COLS])
