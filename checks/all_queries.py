"""Everything that is registered."""

from checks import jobs, neighbours, rasters, relational, shaping, vectors  # noqa: F401
from checks.registry import QUERIES, SQL  # noqa: F401
