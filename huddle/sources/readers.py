"""Scans: CSV with a declared schema, Parquet, multi-part unions, and the
null-token / NaN normalisation that a pandas CSV read does implicitly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huddle.functions.expressions import PANDAS_NA_TOKENS, nan_to_null, null_tokens_to_null


_SCANS: dict = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, ``<sf_dir>/<name>.parquet``.

    The scan DataFrame is reused within a session (the inputs are read-only),
    which saves a file listing and footer read per query."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (id(spark), path)
    cached = _SCANS.get(key)
    if cached is None or cached.sparkSession is not spark:
        cached = _SCANS[key] = spark.read.parquet(path)
    return cached


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


# Numeric columns of the public tracking tables.
KNOWN_TYPES = (dict.fromkeys(("gameId", "playId", "nflId", "frameId"), "bigint")
               | dict.fromkeys(("quarter", "down", "yardsToGo", "yardsGained", "yardlineNumber", "week", "season",
                                "weight", "jerseyNumber", "absoluteYardlineNumber"), "int")
               | dict.fromkeys(("x", "y", "s", "a", "dis", "o", "dir"), "double"))


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | None = None,
             normalize: bool = True) -> DataFrame:
    """CSV with header.  ``normalize`` reads every column as text, maps
    pandas' missing tokens to null, and only then casts: by ``schema``, else by
    ``KNOWN_TYPES``, else by :func:`infer_types` (a further pass over the
    columns that have neither).  So a numeric column with missing tokens stays
    numeric, and not-null filters mean what they mean after a pandas read."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    paths = list(paths) if not isinstance(paths, str) else paths
    if not normalize:
        return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(paths)
    text = reader.csv(paths)
    types = {f.name: f.dataType.simpleString() for f in schema.fields} if schema is not None else {
        c: KNOWN_TYPES[c] for c in text.columns if c in KNOWN_TYPES}
    text = normalize_nulls(text)
    types = infer_types(text, [c for c in text.columns if c not in types]) | types

    def cast(c: str):
        value = F.col(c).try_cast(types[c])
        if types[c] in ("int", "bigint"):  # whole numbers may be written as 3.0
            value = F.coalesce(value, F.col(c).try_cast("double").try_cast(types[c]))
        return value.alias(c)

    return normalize_nulls(text.select(*[cast(c) for c in text.columns]))


# What a CSV read takes for a number, an infinity, a truth value.
_WHOLE = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_INFINITE = r"^\s*[+-]?([iI]nf|[iI]nfinity|INF|INFINITY)\s*$"
_TRUTH = ("True", "TRUE", "true", "False", "FALSE", "false")
#: What holds values of two kinds, in the order of the lattice.
TYPES = ("boolean", "bigint", "double", "string")


def part_types(text: DataFrame, part: str, columns: Sequence[str]) -> DataFrame:
    """One row per part and column: (part, column, type), the type a frame
    reader gives that part alone.  ``text``: all columns as text, missing
    tokens already null.  One aggregate over all parts: whole numbers are
    bigint, with missing values double; numbers are double; truth values
    boolean, with missing values or anything else string; a column without
    any value is double (all missing)."""
    def counts(c: str):
        v = F.col(f"`{c}`")
        whole = v.rlike(_WHOLE) & F.trim(v).try_cast("bigint").isNotNull()
        number = v.rlike(_NUMBER) | v.rlike(_INFINITE)
        return F.struct(F.count(v).alias("some"), F.count_if(v.isNull()).alias("none"), F.count_if(whole).alias("whole"),
                        F.count_if(number).alias("number"), F.count_if(v.isin(list(_TRUTH))).alias("truth")).alias(f"_{columns.index(c)}")

    by_part = text.groupBy(F.col(part).alias("part")).agg(*[counts(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{k}").alias("n")) for k, c in enumerate(columns)])
    n = lambda f: F.col(f"n.{f}")
    kind = F.when((n("whole") == n("some")) & (n("none") == 0) & (n("some") > 0), "bigint").when(
        n("number") == n("some"), "double").when((n("truth") == n("some")) & (n("none") == 0), "boolean").otherwise("string")
    return by_part.select("part", F.inline(rows)).select("part", "column", kind.alias("type"))


def merged_types(types: DataFrame) -> DataFrame:
    """(column, type) over all parts: the least type that holds every part's;
    whole numbers and numbers make double, truth values and numbers string."""
    has = {t: F.bool_or(F.col("type") == t) for t in TYPES}
    mixed = has["boolean"] & (has["bigint"] | has["double"])
    return types.groupBy("column").agg(F.when(has["string"] | mixed, "string").when(has["double"], "double").when(
        has["bigint"], "bigint").otherwise("boolean").alias("type"))


def infer_types(text: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Types of ``columns`` over all files of a text scan, in one pass; only
    one row per column reaches the driver.  Parts that disagree (whole numbers
    in one week, numbers or text in the next) get the type that holds both."""
    if not columns:
        return {}
    tagged = text.select(*[f"`{c}`" for c in columns], F.input_file_name().alias("_part"))
    found = {r["column"]: r["type"] for r in merged_types(part_types(tagged, "_part", list(columns))).collect()}
    return {c: found.get(c, "string") for c in columns}


def read_parts(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet",
               schema: T.StructType | None = None) -> DataFrame:
    """Several files of one logical table (the weekly tracking files) as one
    DataFrame.  A single multi-path scan lets Spark split all files into
    partitions at once; schemas are merged by name."""
    if fmt == "csv":
        return read_csv(spark, list(paths), schema=schema)
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """Union-all by column name; a column missing from a part is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def normalize_nulls(df: DataFrame, tokens: Sequence[str] = PANDAS_NA_TOKENS,
                    columns: Sequence[str] | None = None) -> DataFrame:
    """String columns: missing tokens become null.  Float columns: NaN
    becomes null (Spark's isNotNull keeps NaN)."""
    cols = set(columns) if columns is not None else None
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if cols is None or f.name in cols:
            if isinstance(f.dataType, T.StringType):
                c = null_tokens_to_null(c, tokens)
            elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                c = nan_to_null(c)
        out.append(c.alias(f.name))
    return df.select(*out)
