"""All registered queries."""

from . import q_document, q_geometry, q_pages, q_sources, q_text  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
