"""Data pipelines of ordinary Python functions, run as Spark plans."""

from rowsmith.context import Context
from rowsmith.dataset import DataSet

__all__ = ["Context", "DataSet"]
