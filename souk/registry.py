"""All queries of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from souk.queries import base, checks, document, figures, models, storage  # noqa: F401

QUERIES, ORACLES = base.QUERIES, base.ORACLES
