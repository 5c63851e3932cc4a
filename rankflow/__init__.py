"""rankflow: DataFrame operators for ranked-snapshot data on Apache Spark.

Every operator takes DataFrames plus column names and returns DataFrames, so
Catalyst plans the whole flow (pushdown, pruning, join selection, AQE).
"""

from rankflow.session import build_session, work_dir

__all__ = ["build_session", "work_dir"]
