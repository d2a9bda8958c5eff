"""All registered queries outside the llm subpackage."""

from . import check_queries, file_queries, package_queries, record_queries, stream_queries, table_queries, text_queries  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
