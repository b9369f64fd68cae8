"""Promotion-spillover analytics as Spark jobs.

Sub-packages: ``sources`` (readers, writers, retail views), ``functions`` (column expressions and
small distributed building blocks), ``operators`` (panel, graphs, exposures, estimators, diagnostics)
and ``plans`` (the named queries and their SQL oracles).
"""

from ripplecart.config import StudyConfig

__all__ = ["StudyConfig"]
