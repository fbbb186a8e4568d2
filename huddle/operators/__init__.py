"""DataFrame operators; each takes column roles from a Layout."""

from huddle.operators.evaluate import (  # noqa: F401
    accuracy_by_segment, best_of, classification_report, confusion_matrix, rank_segments,
)
from huddle.operators.frames import (  # noqa: F401
    complete_rows, event_frame_filter, frame_before_event, previous_row_before_last, regex_filter,
    substring_or_filter,
)
from huddle.operators.joins import fanout_join_summary, fanout_report, join_left, join_metrics, merge_frames  # noqa: F401
from huddle.operators.pivot import interaction_features, pivot_sides, side_difference, wide_features  # noqa: F401
from huddle.operators.regress import fitted_values, ols, ols_summary  # noqa: F401
from huddle.operators.slots import (  # noqa: F401
    center_reference, rank_in_role, role_counts, slot_assign, with_center_offset,
)
from huddle.operators.tendencies import (  # noqa: F401
    avg_by, avg_by_formation, avg_by_team, avg_by_team_per_play, distinct_segments, first_attribute,
    leaderboard_by_feature, leaderboard_total, min_group_size, top_bottom,
)
