"""Column roles.

A :class:`Layout` tells every operator which column plays which part (play
keys, frame order, role, lateral coordinate, label text ...).  Two presets:
``TRACKING`` uses the names of the tracking/plays/players tables, ``DRIVER``
uses the names of the stand-in view built from the driver tables
(:mod:`huddle.sources.standin`).
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Slot:
    """A named slot: the ``index``-th row of ``role`` in a play, ordered by the
    lateral coordinate.  ``index=None`` means every row of the role gets the
    slot (the reference's C and TE rule)."""

    name: str
    role: str
    index: int | None = 1


# Role codes, slot names and their left-to-right order.
ROLES = ("T", "G", "C", "TE")
FULL_SLOTS = (
    Slot("LT", "T", 1),
    Slot("LG", "G", 1),
    Slot("C", "C", 1),
    Slot("RG", "G", 2),
    Slot("RT", "T", 2),
    Slot("TE", "TE", 1),
)
LINE_SLOTS = FULL_SLOTS[:5]
# Slot rule of the per-player study: every C and every TE keeps its slot.
STUDY_SLOTS = (
    Slot("LT", "T", 1),
    Slot("RT", "T", 2),
    Slot("LG", "G", 1),
    Slot("RG", "G", 2),
    Slot("C", "C", None),
    Slot("TE", "TE", None),
)


@dataclass(frozen=True)
class Layout:
    keys: tuple[str, ...]
    role: str
    entity: str
    entity_name: str
    lateral: str
    heading: str
    facing: str
    label_source: str
    team: str
    formation: str
    outcome: str
    frame: str | None = None
    event: str | None = None
    pass_col: str | None = None
    x: str | None = None
    line_of_scrimmage: str | None = None
    # extra not-null requirements of the event-frame filter
    required: tuple[str, ...] = ()
    # measures the player study needs instead (None: the same)
    study_required: tuple[str, ...] | None = None
    # deterministic order after the lateral coordinate
    tiebreak: tuple[str, ...] = ()
    left_tokens: tuple[str, ...] = ("LEFT",)
    right_tokens: tuple[str, ...] = ("RIGHT",)
    roles: tuple[str, ...] = ROLES
    entity_group: str | None = None
    label: str = "run_dir"

    @property
    def label_regex(self) -> str:
        return "|".join(self.left_tokens + self.right_tokens)


TRACKING = Layout(
    keys=("gameId", "playId"),
    frame="frameId",
    event="event",
    role="position",
    entity="nflId",
    entity_name="displayName",
    lateral="y",
    heading="dir",
    facing="o",
    label_source="rushLocationType",
    pass_col="passResult",
    team="possessionTeam",
    formation="offenseFormation",
    outcome="yardsGained",
    x="x",
    line_of_scrimmage="absoluteYardlineNumber",
    required=("absoluteYardlineNumber", "x", "y", "s", "dir", "o", "a", "dis"),
    # the study's rows may lack the speed
    study_required=("absoluteYardlineNumber", "x", "y", "dir", "o", "a", "dis"),
    tiebreak=("nflId", "frameId"),
)

# Stand-in on the driver tables (see huddle.sources.standin and FIXTURES.md):
# play = order (within its customer), player = part, role from flag/status,
# y/dir/o = extendedprice/quantity/discount, label text = order priority.
DRIVER = Layout(
    keys=("o_custkey", "l_orderkey"),
    role="pos",
    entity="l_partkey",
    entity_name="p_name",
    lateral="l_extendedprice",
    heading="l_quantity",
    facing="l_discount",
    label_source="o_orderpriority",
    team="c_mktsegment",
    formation="o_orderstatus",
    outcome="o_totalprice",
    x="l_tax",
    line_of_scrimmage="l_discount",
    required=("l_extendedprice", "l_quantity", "l_discount", "l_tax"),
    tiebreak=("l_linenumber", "l_partkey"),
    # Priority words standing for the two run directions.
    left_tokens=("URGENT", "HIGH"),
    right_tokens=("LOW", "NOT"),
    entity_group="p_brand",
)
