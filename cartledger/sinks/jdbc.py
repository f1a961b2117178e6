"""Full refresh of a relational store."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cartledger.schemas import TABLES, conform
from cartledger.sources.jdbc import Store, count_rows
from cartledger.warehouse import Warehouse


def write_options(store: Store, table: str) -> dict[str, str]:
    return {**store.options(table), "batchsize": str(store.batch_rows)}


def truncate_options(store: Store, table: str) -> dict[str, str]:
    """Options under which overwriting with an empty frame empties the table in place."""
    return {**store.options(table), "truncate": "true", "cascadeTruncate": "true"}


def append(df: DataFrame, store: Store, table: str) -> None:
    df.write.format("jdbc").options(**write_options(store, table)).mode("append").save()


def truncate(like: DataFrame, store: Store, table: str) -> None:
    like.limit(0).write.format("jdbc").options(**truncate_options(store, table)).mode("overwrite").save()


def refresh(w: Warehouse, store: Store) -> dict[str, int]:
    """Empty all tables, children first, then load them, parents first.

    The store numbers its own surrogate keys.  A task that is run again after
    its rows were committed would load them twice, so each table's rows are
    counted in the store afterwards; a difference raises.
    """
    stored = w.stored()
    frames = {key: conform(stored[key], table) for key, table in TABLES.items()}
    for key in reversed(TABLES):
        truncate(frames[key], store, TABLES[key].name)
    loaded = {}
    for key, df in frames.items():
        name = TABLES[key].name
        append(df, store, name)
        expected, found = df.count(), count_rows(w.spark, store, name)
        if expected != found:
            raise RuntimeError(f"{name}: {expected} rows sent, {found} rows in the store")
        loaded[name] = found
    return loaded
