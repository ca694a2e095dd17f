"""vulnsift: a Spark-native engine for building and judging vulnerability-detection
training data.

Every operator is ``DataFrame (+ parameters) -> DataFrame``; scalar helpers are
``Column -> Column``. Nothing in a core path runs Python per row.
"""

from vulnsift.session import get_session, checkpoint_dir, read_table

__all__ = ["get_session", "checkpoint_dir", "read_table"]
