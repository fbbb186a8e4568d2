"""huddle: tendency analysis of keyed, ordered, role-labelled tracking rows on Spark.

Every operator takes a DataFrame plus a :class:`huddle.layout.Layout` that names
the columns it works on, so the same code runs on tracking data and on the
driver's stand-in tables.
"""

from huddle.layout import DRIVER, TRACKING, Layout, FULL_SLOTS, LINE_SLOTS, Slot

__all__ = ["Layout", "Slot", "TRACKING", "DRIVER", "FULL_SLOTS", "LINE_SLOTS"]
