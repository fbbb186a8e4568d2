"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huddle.session import cut_lineage

#: One Python call works on about this many characters at a time.
BLOCK_CHARS = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns an operator reads, whatever else ``docs`` has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder of ``spark.checkpoint.dir``."""
    return cut_lineage(df, name)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (a written table) marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_CHARS) -> Iterator[dict]:
    """Slices of Arrow batches with about ``size`` bytes of ``text`` each (one
    row at least), as Python lists by column; nulls in ``text`` become ''."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        lengths = [0 if n is None else n for n in pc.binary_length(col).to_pylist()]
        at, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > size:
                yield _lists(batch.slice(at, i - at), text)
                at, held = i, 0
            held += n
        yield _lists(batch.slice(at), text)


def _lists(batch: pa.RecordBatch, text: str) -> dict:
    out = batch.to_pydict()
    empty = b"" if pa.types.is_binary(batch.schema.field(text).type) else ""
    out[text] = [empty if t is None else t for t in out[text]]
    return out
