"""tabfold: tabular profiling, encoding, sampling, scoring and blending on Spark.

Every step is a DataFrame transformation. Steps that learn statistics come as
``fit_*`` (returns a small DataFrame) and ``apply_*`` (joins or maps it onto any
rows), so statistics learned on training rows are reused unchanged elsewhere.
"""

from tabfold.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
