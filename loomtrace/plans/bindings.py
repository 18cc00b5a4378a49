"""All bound queries."""

from . import bind_capture, bind_score, bind_select, bind_stats  # noqa: F401
from .catalog import ORACLES, QUERIES  # noqa: F401
