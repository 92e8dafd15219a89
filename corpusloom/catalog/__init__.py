"""Registered queries; importing the modules registers them."""

from corpusloom.catalog import (  # noqa: F401
    dataset_queries, file_queries, scalar_queries, select_queries, style_queries, unit_queries,
)
from corpusloom.catalog.registry import QUERIES, SQL


def all_queries():
    return dict(QUERIES)


def all_sql():
    return dict(SQL)
