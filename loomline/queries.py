"""All queries of the library. Importing the plan modules fills the registry."""

from loomline.plans import q_files, q_resample, q_rows, q_scores, q_windows  # noqa: F401
from loomline.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
