"""Named queries and the SQL that gives the same rows."""

from __future__ import annotations

from fairlead.plans import queries_geo, queries_graph, queries_misc, queries_route

PARTS = (queries_geo, queries_graph, queries_misc, queries_route)


def queries():
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql():
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}


def entry(spark, sf_dir):
    """Routes from customers' to suppliers' pins."""
    return queries_graph.route_distance(spark, sf_dir)
