"""The registered queries of the engine itself, by name, and their SQL."""

from folioscope.plans import indexing, lookups, metadata, searching, watching

_ALL = [metadata.query, indexing.query, searching.query, lookups.query, watching.query]
QUERIES: dict = {name: q for r in _ALL for name, q in r.queries.items()}
ORACLES: dict = {name: q for r in _ALL for name, q in r.sql.items()}
