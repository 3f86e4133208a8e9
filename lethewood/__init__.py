"""Exact unlearning for tree ensembles, expressed as Spark DataFrame jobs."""

from .config import RunConfig

__all__ = ["RunConfig"]
