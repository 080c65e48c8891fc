"""All core queries and their SQL."""

from . import core_problems, ingest, measures, reviews

_MODULES = (core_problems, reviews, measures, ingest)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
