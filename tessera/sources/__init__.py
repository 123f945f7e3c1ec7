"""Table sources and sinks."""

from .copying import copy_from, copy_to
from .parquet import TABLES, load, register_views

__all__ = ["TABLES", "copy_from", "copy_to", "load", "register_views"]
