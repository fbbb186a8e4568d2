"""Tables bucketed by the play keys.

Tracking and play rows written into equally many buckets of the same keys are
already where a join, a rank or a count on these keys needs them: the plan has
no exchange between the scan and the result, however often the tables are
read.  Each bucket is read by one task, so the number of buckets is chosen
from the size, and a table in which one key holds a large share is refused
(use ``write_clustered`` and the shuffle plans, which split it)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from huddle.operators.joins import hot_keys
from huddle.session import checkpoint_dir

#: A key may hold up to one row in SHARES of a bucketed table.
SHARES = 20
LEAST_ROWS = 100_000


def write_bucketed(df: DataFrame, keys: Sequence[str], buckets: int, order: Sequence[str] = (), name: str | None = None,
                   path: str | None = None) -> DataFrame:
    """Writes ``df`` as table ``name`` of ``buckets`` buckets by ``keys``,
    sorted by them and ``order``, one file a bucket, and reads it back.
    Without a path it lies in the shared checkpoint folder."""
    spark = df.sparkSession
    if df.count() >= LEAST_ROWS and not (hot := hot_keys(df, keys, SHARES)).isEmpty():
        raise ValueError(f"a key holds more than one row in {SHARES}: {hot.first()}")
    name = name or f"huddle_{uuid.uuid4().hex}"
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/huddle-tables/bucketed-{name}"
    # the same hash as the buckets': every task writes one file
    (df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys)
     .sortBy(*keys, *[c for c in order if c not in keys]).option("path", path).saveAsTable(name))
    return spark.table(name)


def with_play_and_ranks(tracking: DataFrame, plays: DataFrame, keys: Sequence[str], role: str, order: Sequence[str],
                        counted: str) -> DataFrame:
    """Tracking rows with their play's columns (J1), the rank in their role
    (W1, ``slot``) and the play's number of ``counted`` rows (J5); on bucketed
    tables without any exchange."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    slot = F.row_number().over(Window.partitionBy(*keys, role).orderBy(*order))
    counts = tracking.groupBy(*keys).agg(F.count_if(F.col(role) == counted).alias(f"num_{counted}s"))
    ranked = tracking.withColumn("slot", slot)
    hint = [d.hint("merge") for d in (plays, counts)]
    return ranked.join(hint[0], list(keys), "left").join(hint[1], list(keys), "left")
