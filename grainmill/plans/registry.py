"""Name -> query and name -> oracle SQL, gathered from the plan modules."""

from . import corpus, evaluation, files, tokens  # noqa: F401  (they register their queries)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
