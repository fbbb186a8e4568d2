"""Column expressions (all built-in Spark functions, so they stay inside
whole-stage codegen and push down where Catalyst allows)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from huddle.layout import Slot

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# pandas' default missing-value tokens for read_csv.
PANDAS_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Team colour table of the accuracy-vs-yards chart, default #333333.
TEAM_COLORS = {
    "TEN": "#4B92DB", "DEN": "#FB4F14", "CIN": "#FB4F14", "CLE": "#311D00", "MIA": "#008E97",
    "BAL": "#241773", "NYG": "#0B2265", "PIT": "#FFB612", "WAS": "#5A1414", "ATL": "#A71930",
    "NO": "#D3BC8D", "ARI": "#97233F", "KC": "#E31837", "TB": "#D50A0A", "NE": "#002244",
    "PHI": "#004C54", "HOU": "#A71930", "SF": "#AA0000", "JAX": "#006778", "DAL": "#041E42",
    "MIN": "#4F2683", "NYJ": "#125740", "SEA": "#69BE28",
}
DEFAULT_COLOR = "#333333"


def classify_play(pass_col: ColumnOrName | None, run_col: ColumnOrName) -> Column:
    """'pass' if the pass column is set, else 'run' if the run column is set,
    else null; pass wins when both are set (B14)."""
    run = F.when(_c(run_col).isNotNull(), F.lit("run"))
    if pass_col is None:
        return run
    return F.when(_c(pass_col).isNotNull(), F.lit("pass")).otherwise(run)


def is_run(pass_col: ColumnOrName | None, run_col: ColumnOrName) -> Column:
    """``classify_play(...) == 'run'`` written as plain null tests, which Spark
    pushes into the Parquet scan (the CASE form is not pushed)."""
    cond = _c(run_col).isNotNull()
    if pass_col is not None:
        cond = _c(pass_col).isNull() & cond
    return cond


def _contains_any(col: Column, tokens: Iterable[str]) -> Column:
    out = None
    for t in tokens:
        e = col.contains(t)
        out = e if out is None else (out | e)
    return out if out is not None else F.lit(False)


def direction_label(col: ColumnOrName, left_tokens: Sequence[str] = ("LEFT",),
                    right_tokens: Sequence[str] = ("RIGHT",)) -> Column:
    """'left' if any left token is a substring, else 'right' if any right token
    is, else null: left is tested first (B15)."""
    c = _c(col)
    return (F.when(_contains_any(c, left_tokens), F.lit("left"))
            .when(_contains_any(c, right_tokens), F.lit("right")))


def relative_offset(col: ColumnOrName, reference: ColumnOrName) -> Column:
    """Offset from a reference line, e.g. x relative to the line of scrimmage."""
    return _c(col) - _c(reference)


def slot_name(role: ColumnOrName, index: ColumnOrName, slots: Sequence[Slot]) -> Column:
    """Slot of a row from its role and its rank within the role; null when no
    slot matches (third tackle and so on, B5)."""
    r, i = _c(role), _c(index)
    out = None
    for s in slots:
        cond = r == F.lit(s.role)
        if s.index is not None:
            cond = cond & (i == F.lit(s.index))
        out = F.when(cond, F.lit(s.name)) if out is None else out.when(cond, F.lit(s.name))
    return out


def center_offset(lateral: ColumnOrName, center: ColumnOrName, slot: ColumnOrName | None = None,
                  center_slot: str = "C", mode: str = "absolute") -> Column:
    """Lateral offset from the center.  ``mode='absolute'``: the center keeps
    its absolute coordinate (wide features); ``mode='zero'``: plain difference,
    so the center is 0 (player study) (B6)."""
    diff = _c(lateral) - _c(center)
    if mode == "zero" or slot is None:
        return diff
    return F.when(_c(slot) == F.lit(center_slot), _c(lateral)).otherwise(diff)


def interaction(a: ColumnOrName, b: ColumnOrName) -> Column:
    return _c(a) * _c(b)


def map_lookup(col: ColumnOrName, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """Literal map lookup with a default, evaluated in codegen."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    looked = F.create_map(*pairs)[_c(col)]
    return looked if default is None else F.coalesce(looked, F.lit(default))


def null_tokens_to_null(col: ColumnOrName, tokens: Sequence[str] = PANDAS_NA_TOKENS) -> Column:
    c = _c(col)
    return F.when(c.isin(list(tokens)), F.lit(None)).otherwise(c)


def nan_to_null(col: ColumnOrName) -> Column:
    c = _c(col)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def split_bucket(keys: Sequence[ColumnOrName], seed: int = 42, buckets: int = 100) -> Column:
    """Deterministic bucket in [0, buckets) from a hash of the key: a row's
    train/test side does not depend on partitioning or row order.  The same
    number is ``cast('0x'||substr(md5(...),1,8) as ubigint) % 100`` in SQL."""
    text = F.concat_ws(":", F.lit(str(seed)), *[_c(k).cast("string") for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))
