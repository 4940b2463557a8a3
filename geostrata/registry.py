"""Queries of the engine and the same queries in DuckDB's SQL."""

from __future__ import annotations

from .operators import catalogue, cells, geometry, ground, labels, matching, rasters, surveys, terrain, training, warp
from .plans import dataset, outlines, pipelines

MODULES = (cells, terrain, matching, rasters, catalogue, labels, geometry, ground, training, surveys, warp, pipelines, outlines, dataset)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
