"""Named queries over the input tables, each paired with the SQL that must give the same rows."""

from .registry import ORACLES, QUERIES, query  # noqa: F401
from . import (similarity, hierarchy, neighbors, linking, review, text, claims, integrity, clusters, variants, search, listings, publish, metrics, activity)  # noqa: F401
