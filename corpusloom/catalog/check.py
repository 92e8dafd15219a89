"""Compare registered queries with their SQL on the same tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from corpusloom.catalog.registry import QUERIES, SQL

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values as text, rows sorted."""
    frame = frame[sorted(frame.columns)]
    text = frame.map(lambda v: "NULL" if v is None or v is pd.NA or v != v else repr(
        v.item() if hasattr(v, "item") else v))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def compare(spark: SparkSession, sf_dir: str, name: str, queries=None, sql=None) -> str | None:
    """None when equal, else what differs."""
    queries, sql = queries or QUERIES, sql or SQL
    got_frame = queries[name](spark, sf_dir)
    columns = got_frame.columns
    rows = [tuple(r) for r in got_frame.collect()]
    got = canonical(pd.DataFrame(rows, columns=columns, dtype=object))
    relation = duck(sf_dir).execute(sql[name])
    names = [d[0] for d in relation.description]
    want = canonical(pd.DataFrame(relation.fetchall(), columns=names, dtype=object))
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} != {list(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}" + _first_difference(got, want)
    if not got.equals(want):
        return "values differ" + _first_difference(got, want)
    return None


def _first_difference(got: pd.DataFrame, want: pd.DataFrame) -> str:
    merged = got.merge(want, how="outer", indicator=True)
    odd = merged[merged["_merge"] != "both"]
    return f"; {len(odd)} rows, e.g. " + " | ".join(str(r)[:1500] for r in odd.head(2).to_dict("records"))
