from echoframe.catalog import columns, comparing, fitting, windows  # noqa: F401
from echoframe.catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
