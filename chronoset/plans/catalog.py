"""The registered queries and the DuckDB SQL that has the same rows: importing this module registers all of them."""

from __future__ import annotations

from . import chord_queries, error_queries, file_queries, grid_queries, kernel_queries, line_queries, locate_queries, notation_queries, note_queries, page_queries, place_queries, record_queries, star_queries, text_queries  # noqa: F401
from .registry import FLAGSHIP, ORACLE_SQL, QUERIES, query  # noqa: F401
