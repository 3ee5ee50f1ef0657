"""All queries of the library and the equivalent SQL, by name."""

from __future__ import annotations

from tidewatch.operators import backfill, calendars, checks, choices, evaluation, filtering, intervals, lifecycle, listing, machines, relations, response, revisions, rollups, series, spectra, stories, texts
from tidewatch.streaming import arrivals, assignment

MODULES = (rollups, relations, series, texts, lifecycle, filtering, calendars, listing, intervals, checks, evaluation, stories, response, spectra, machines, revisions, choices, backfill, arrivals, assignment)
QUERIES: dict = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
