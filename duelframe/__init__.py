"""Analytics for two-sided contest tables on PySpark."""

from duelframe.layout import DEFAULT, Layout

__all__ = ["DEFAULT", "Layout"]
