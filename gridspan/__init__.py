"""Coordinate-partitioned analytics on Spark."""

from gridspan.functions import col
from gridspan.session import Frame, Session
from gridspan.sources.table import Table

__all__ = ["Frame", "Session", "Table", "col"]
