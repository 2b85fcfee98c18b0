"""Named queries over a folder of tables."""

from . import bounds, datasets, encoders, graphs, lookups, metrics, names, programs, syntax, vectors  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
