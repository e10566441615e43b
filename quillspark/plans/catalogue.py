"""All queries of the engine by name, with the SQL that checks them."""

from . import adapters, chain, checks, decoding, pricing, repricing, scans, series, statement, stores, streams, texts  # noqa: F401  they register their queries
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
