"""Annual statistics and population-exposure indicators from sensor readings, as PySpark DataFrame operators."""

from .rules import Rules
from .schemas import MissingColumnsError

__all__ = ["MissingColumnsError", "Rules"]
