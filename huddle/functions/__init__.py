from huddle.functions.expressions import (  # noqa: F401
    center_offset,
    classify_play,
    direction_label,
    interaction,
    is_run,
    map_lookup,
    nan_to_null,
    null_tokens_to_null,
    relative_offset,
    slot_name,
    split_bucket,
    PANDAS_NA_TOKENS,
    TEAM_COLORS,
)
