"""All queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import queries_corpus, queries_dedup, queries_search, queries_text

MODULES = (queries_dedup, queries_search, queries_text, queries_corpus)

QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
