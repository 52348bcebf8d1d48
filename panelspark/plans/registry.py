"""All core queries by name, and their SQL."""

from __future__ import annotations

from . import benchmark_queries, feature_queries, inference_queries, life_queries, metric_queries, more_queries, pair_queries, problems, problems_sql, relation_queries, strategy_queries

QUERIES = dict(problems.QUERIES)
SQL = dict(problems_sql.SQL)
for _m in (feature_queries, benchmark_queries, metric_queries, strategy_queries, inference_queries, more_queries, life_queries, pair_queries, relation_queries):
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
