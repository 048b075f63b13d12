"""All registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

from evalmill.plans import chats, corpora, files, runs, streams, suites, traces

_PARTS = (corpora, files, runs, traces, suites, chats, streams)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
