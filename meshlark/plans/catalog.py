"""All registered queries. Importing the modules registers them."""

from . import graphs, market, names, reads, records, signals, telemetry  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
