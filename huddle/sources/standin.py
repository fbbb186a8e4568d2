"""Stand-in for the tracking tables, built from the driver tables.

=============  =====================================================
tracking row   lineitem row
play key       (o_custkey, l_orderkey): game = customer, play = order
player         l_partkey, name p_name, group p_brand
role           flag A = T, flag N = G, flag R: status F = C, else TE
y / dir / o    l_extendedprice / l_quantity / l_discount
label text     o_orderpriority (URGENT, HIGH = left; LOW, NOT = right)
team / form.   c_mktsegment / o_orderstatus
outcome        o_totalprice
=============  =====================================================

``driver_frames`` builds it with the same left joins as the merge of the
tracking data (on play, game and player keys); ``FRAMES_SQL`` is the same
view as SQL text for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huddle.functions.expressions import direction_label
from huddle.layout import DRIVER
from huddle.sources.readers import read_table


def role_code(flag: str = "l_returnflag", status: str = "l_linestatus"):
    return (F.when(F.col(flag) == "A", "T")
            .when(F.col(flag) == "N", "G")
            .when(F.col(status) == "F", "C")
            .otherwise("TE"))


_FRAMES: dict = {}


def driver_frames(spark: SparkSession, sf_dir: str, *dimensions: str, tasks: int | None = None) -> DataFrame:
    """The stand-in frames as a lazy DataFrame: line items with their orders,
    and the ``dimensions`` (customer, part) whose columns the query uses.
    Spark cannot drop a left join to a side not known to be unique, so one
    that nothing uses would shuffle every row.  The plan object is reused
    within a session (nothing is cached in memory; every query still reads
    the tables), which spares rebuilding and re-analysing the joins.

    ``tasks``: dealt by order over so many tasks, which serves the join and any
    window by play, instead of as many as the session says."""
    key = (id(spark), sf_dir.rstrip("/"), dimensions, tasks)
    hit = _FRAMES.get(key)
    if hit is not None and hit.sparkSession is spark:
        return hit
    _FRAMES[key] = out = _build_frames(spark, sf_dir, dimensions, tasks)
    return out


#: Rows of a task of a whole sort.
TASK_ROWS = 500_000


def sort_tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks for a window over all line items, so that what one sorts does not
    grow with the table; None while there are no more than the session's cores."""
    n = -(-read_table(spark, sf_dir, "lineitem").count() // TASK_ROWS)
    return n if n > spark.sparkContext.defaultParallelism else None


def _build_frames(spark: SparkSession, sf_dir: str, dimensions: tuple[str, ...], tasks: int | None = None) -> DataFrame:
    from huddle.operators.joins import join_left

    lines, orders = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders")
    if tasks:
        lines, orders = lines.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")
    out = join_left(lines, orders, [("l_orderkey", "o_orderkey")])
    if "customer" in dimensions:
        out = join_left(out, read_table(spark, sf_dir, "customer"), [("o_custkey", "c_custkey")])
    if "part" in dimensions:
        part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
        out = join_left(out, part, [("l_partkey", "p_partkey")])
    return (out
            .withColumn("pos", role_code())
            .withColumn("run_dir", direction_label("o_orderpriority", DRIVER.left_tokens,
                                                   DRIVER.right_tokens)))


def driver_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered frames: one user is one play, (ts, event_id) is the frame order."""
    return read_table(spark, sf_dir, "events")


FRAMES_SQL = """
frames AS (
  SELECT l.*, o.*, c.*, p.p_name, p.p_brand,
    CASE WHEN l_returnflag = 'A' THEN 'T' WHEN l_returnflag = 'N' THEN 'G'
         WHEN l_linestatus = 'F' THEN 'C' ELSE 'TE' END AS pos,
    CASE WHEN o_orderpriority LIKE '%URGENT%' OR o_orderpriority LIKE '%HIGH%' THEN 'left'
         WHEN o_orderpriority LIKE '%LOW%' OR o_orderpriority LIKE '%NOT%' THEN 'right' END AS run_dir
  FROM lineitem l
  LEFT JOIN orders o ON l_orderkey = o_orderkey
  LEFT JOIN customer c ON o_custkey = c_custkey
  LEFT JOIN (SELECT p_partkey, p_name, p_brand FROM part) p ON l_partkey = p_partkey
)"""
