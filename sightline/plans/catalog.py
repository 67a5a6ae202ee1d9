"""All queries of the reference's own operators; importing a module registers its."""

from ..operators import archive, consensus, curation, fusion, gates, joins, matching, quality, scalars, telemetry, upsert  # noqa: F401
from ..sources import files  # noqa: F401
from ..streaming import streams  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
