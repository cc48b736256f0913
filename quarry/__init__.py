"""quarry: search, moderation, evaluation and ML-prep jobs as Spark DataFrame operators.

Every public operator takes DataFrames (plus plain parameters) and returns a
DataFrame; nothing is collected to the driver except bounded, size-checked
query blocks and fitted model parameters.
"""

from quarry.session import build_session, checkpoint_dir  # noqa: F401

__all__ = ["build_session", "checkpoint_dir"]
