"""All registered queries: importing the query modules fills the registry."""

from __future__ import annotations

from tabfold.plans import q_clean, q_encode, q_eval, q_features, q_io, q_joins, q_models, q_nulls, q_profile, q_select, recipes  # noqa: F401,E501
from tabfold.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
