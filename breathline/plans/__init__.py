"""Whole jobs put together from the operators."""

from .analysis import Analysis, analyse
from .assessment import Assessment, assess, assess_annual

__all__ = ["Analysis", "Assessment", "analyse", "assess", "assess_annual"]
