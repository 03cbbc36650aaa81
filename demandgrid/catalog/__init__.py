"""Registered queries over the benchmark tables, each with its SQL twin where SQL can say it."""

from demandgrid.catalog.base import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
