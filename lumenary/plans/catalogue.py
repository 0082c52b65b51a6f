"""Registry of the engine's queries and their DuckDB counterparts."""

from __future__ import annotations

from lumenary.plans import corpus, evaluation, retrieval
from lumenary.session import ship


def _shipped(query):
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _shipped(q) for module in (corpus, retrieval, evaluation) for name, q in module.QUERIES.items()}
ORACLE_SQL: dict[str, str] = corpus.ORACLE_SQL | retrieval.ORACLE_SQL | evaluation.ORACLE_SQL
