"""All registered queries over the given tables, and their SQL."""

from __future__ import annotations

from ordergraph.plans import graph_queries, sample_queries


def queries():
    return graph_queries.QUERIES | sample_queries.QUERIES


def oracle_sql():
    return graph_queries.SQL | sample_queries.SQL
