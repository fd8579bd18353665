"""All queries of the core."""

from . import documents, extraction, graph, outputs, search, states  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
