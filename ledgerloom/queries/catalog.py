"""All queries of the core, by name."""

from __future__ import annotations

from ledgerloom.queries import problems, records, reference, texts

# `records` and `texts` register their queries in the tables of `reference` when they are imported.
assert records.query is texts.query is reference.query
QUERIES = {**reference.QUERIES, **problems.QUERIES}
SQL = {**reference.SQL, **problems.SQL}
