"""Choice of samples and items, and their state before evaluation."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(rows: DataFrame, key: str, order: str, start: int = 0, n: int | None = None) -> DataFrame:
    """Of each key, ``n`` rows from position ``start`` on; all that follow where n is None."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    wanted = F.col("_at") >= start
    return rows.withColumn("_at", at).where(wanted if n is None else wanted & (F.col("_at") < start + n)).drop("_at")


def chosen(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is listed."""
    return rows.join(ids.select(key), key, "left_semi")


def unknown(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The listed keys that no row has."""
    return ids.select(key).join(rows, key, "left_anti")


def chosen_or_raise(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is listed; an error that names some of the keys that no row has."""
    missing = [r[0] for r in unknown(rows, ids, key).limit(5).collect()]
    if missing:
        raise ValueError(f"unknown {key}: {', '.join(map(str, missing))}")
    return chosen(rows, ids, key)


def status(corrupted: Column, missing: Column, empty: Column) -> Column:
    """The first state that holds; items in the first three score 0 and still count."""
    return F.when(corrupted, "corrupted").when(missing, "missing").when(empty, "empty").otherwise("evaluated")
