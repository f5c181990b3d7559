"""Registered queries and their SQL."""

from lattica.queries import corpus, evaluation, language, scenes, sequences, spatial, streams

_PARTS = (spatial, scenes, language, corpus, sequences, evaluation, streams)
QUERIES = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
ORACLE_SQL = {k: s for p in _PARTS for k, s in p.ORACLE_SQL.items()}
