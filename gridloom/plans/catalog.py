"""All queries over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from . import q_core, q_fields, q_forest, q_grid, q_images, q_learn, q_models, q_more, q_warp  # noqa: F401  they register their queries
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
