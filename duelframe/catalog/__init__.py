from duelframe.catalog import preparation, histories, modelling, fits, reports  # noqa: F401
from duelframe.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
