"""Every registered query outside the llm package, with its SQL."""

from __future__ import annotations

from .plans import catalog

FLAGSHIP = "incremental_plan"
QUERIES: dict = catalog.QUERIES
ORACLES: dict[str, str] = catalog.ORACLES
