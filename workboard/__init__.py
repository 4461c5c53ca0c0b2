"""workboard: work-tracking analytics (people, projects, memberships, tasks) on Spark.

Every public function takes and returns DataFrames (or Columns); nothing is
collected to the driver except bounded scalars (counts, page numbers, one row
of statistics per partition).
"""

from workboard.session import build_session, checkpoint_root

__all__ = ["build_session", "checkpoint_root"]
