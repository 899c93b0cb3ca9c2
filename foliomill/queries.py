"""The registered queries of the core and their SQL."""

from foliomill.plans import blocks, exports, pages, readback, runs, scalars, store, weights

_PARTS = (weights, store, scalars, blocks, pages, exports, readback, runs)
QUERIES = {name: fn for part in _PARTS for name, fn in part.query.queries.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.query.sql.items()}
