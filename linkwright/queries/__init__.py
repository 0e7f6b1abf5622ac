"""Registered queries of the linkage library, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from linkwright.queries.registry import ORACLES, QUERIES  # noqa: F401
from linkwright.queries import linkage, matching, states, texts  # noqa: F401, E402, I001
