"""The subpackage's queries and their SQL, by name."""

from tidepool.llm import encode, mix, neighbours, rank, scans, spans, split

_MODULES = [encode, mix, neighbours, rank, scans, spans, split]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
