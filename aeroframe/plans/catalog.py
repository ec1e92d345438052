"""All query modules, imported for what they register."""

from . import queries_geometry, queries_io, queries_missions, queries_scalar, queries_terrain, queries_tracks  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
