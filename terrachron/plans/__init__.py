"""Registered queries of the library."""

from . import border_checks, derivations, files_and_pages, notes, records, relations, reports, text_and_search, time_and_place  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
