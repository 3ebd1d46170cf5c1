"""Registered queries of the library and their DuckDB oracles."""

from . import null_queries, panel_queries, price_queries, share_queries, study_queries, table_queries

_ALL: dict[str, tuple] = {}
for _m in (panel_queries, price_queries, share_queries, null_queries, study_queries, table_queries):
    _ALL |= _m.Q

QUERIES = {k: v[0] for k, v in _ALL.items()}
ORACLE_SQL = {k: v[1] for k, v in _ALL.items() if v[1]}
