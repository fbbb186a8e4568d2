from huddle.sources.readers import (  # noqa: F401
    normalize_nulls,
    read_csv,
    read_parquet,
    read_parts,
    read_table,
    union_parts,
)
from huddle.sources.writers import write_clustered, write_parquet  # noqa: F401
from huddle.sources.standin import driver_frames, FRAMES_SQL  # noqa: F401
