"""The catalogue of queries, one for each operator, with the SQL that gives the same rows."""

from .catalogue import QUERIES
from .oracle import ORACLES

__all__ = ["ORACLES", "QUERIES"]
