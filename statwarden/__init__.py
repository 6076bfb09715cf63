"""Column-statistics upkeep for fleets of Spark tables.

Every public function maps DataFrames to DataFrames (or Columns to Columns);
no job starts until the caller runs an action.
"""

from statwarden.govern import Fleet, GovernanceError, GovernanceRequest, RunPlan, finish, govern, govern_targeted, second_look, summarize, within_window

__all__ = ["Fleet", "GovernanceError", "GovernanceRequest", "RunPlan", "finish", "govern", "govern_targeted", "second_look", "summarize", "within_window"]
