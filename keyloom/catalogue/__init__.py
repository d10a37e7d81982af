"""Queries by name over the driver's tables, one or more for each operator, and their SQL."""

from . import collections, events, keys, spatial, wider  # noqa: F401  they fill the register
from .base import ORACLES, QUERIES  # noqa: F401
