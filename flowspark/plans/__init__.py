"""The registered queries and their SQL."""

from . import replays, streams  # noqa: F401  register their queries
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
