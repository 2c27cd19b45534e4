"""Queries by subject; importing the modules fills the catalog."""

from loomspan.plans import aggregates, algebra, crosssection, inference, market, paths, pipelines, relational, shuffles, sinks, sources, windows

__all__ = ["aggregates", "algebra", "crosssection", "inference", "market", "paths", "pipelines", "relational", "shuffles", "sinks", "sources", "windows"]
