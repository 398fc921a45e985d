"""File system drivers; importing the package registers them."""

from . import ext, fat, small  # noqa: F401
from .records import DRIVERS, Record, objects, paths, scan

__all__ = ["DRIVERS", "Record", "objects", "paths", "scan"]
