"""Early-warning risk analytics on Spark DataFrames."""

from .config import N_CLASSES, STUDENT, Override, RiskConfig

__all__ = ["N_CLASSES", "STUDENT", "Override", "RiskConfig"]
