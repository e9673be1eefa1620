"""Registered queries over the supplied tables."""

from tablewright.queries import encode_scale, fitting, learning, modelling, prepare, scenarios, scoring
from tablewright.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "encode_scale", "fitting", "learning", "modelling", "prepare", "scenarios", "scoring"]
