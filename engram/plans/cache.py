"""Replies and vectors that a model has given before, by the content that it was asked for."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.models import embedding, replies
from engram.plans.state import kept
from engram.sources.segments import Segments

TABLES = {"replies": "graph_id STRING, reply STRING", "vectors": "graph_id STRING, vector ARRAY<FLOAT>"}


class ModelCache:
    """A stored table from the digest of (version, text) to what the model gave.

    Each distinct text that isn't known is asked once, however many rows have it, and stored in one
    commit; failed replies are not stored. ``version`` names the model with all that its
    answers depend on. Rows keep all their columns; a null text has no reply.
    """

    def __init__(self, spark: SparkSession, path: str, version: str):
        self.store, self.version = Segments(spark, path, TABLES), version

    def _given(self, rows: DataFrame, text: Column, table: str, value: str, call: Callable[[Column], Column], name: str, fine: Callable[[Column], Column], shape: Callable[[Column], Column]) -> DataFrame:
        keyed = rows.withColumn("_text", text).withColumn("_digest", F.sha2(F.concat(F.lit(f"{self.version}\0"), "_text").cast("binary"), 256))
        known = self.store.read(table).select(F.col("graph_id").alias("_digest"), F.col(value).alias("_given"))
        asked = keyed.where("_digest IS NOT NULL").groupBy("_digest").agg(F.first("_text").alias("_text")).join(known, "_digest", "left_anti")
        new = kept(asked.select("_digest", call(F.col("_text")).alias("_raw")))
        fresh = new.where(fine(F.col("_raw"))).select(F.col("_digest").alias("graph_id"), shape(F.col("_raw")).alias(value))
        if not fresh.isEmpty():
            self.store.commit(add={table: fresh})
        raw = new.schema["_raw"].dataType
        old = known.select("_digest", (F.struct(F.col("_given").alias("reply"), F.lit(None).cast("string").alias("error")) if table == "replies" else F.col("_given")).cast(raw).alias("_raw"))
        return keyed.join(old.unionByName(new), "_digest", "left").withColumn(name, F.col("_raw")).drop("_text", "_digest", "_raw")

    def replies(self, rows: DataFrame, prompt: Column, make, name: str = "r") -> DataFrame:
        """The rows with struct<reply, error>."""
        return self._given(rows, prompt, "replies", "reply", lambda c: replies(c, make), name, lambda r: r["error"].isNull(), lambda r: r["reply"])

    def vectors(self, rows: DataFrame, text: Column, make, name: str = "embedding") -> DataFrame:
        """The rows with the vector of a text, of which a null one is empty."""
        return self._given(rows, F.coalesce(text, F.lit("")), "vectors", "vector", lambda c: embedding(c, make), name, lambda v: v.isNotNull(), lambda v: v)


def with_replies(rows: DataFrame, prompt: Column, make, cache: ModelCache | None = None, name: str = "r") -> DataFrame:
    """The rows with the model's struct<reply, error>, from the cache where there is one."""
    return rows.withColumn(name, replies(prompt, make)) if cache is None else cache.replies(rows, prompt, make, name)


def with_vectors(rows: DataFrame, text: Column, make, cache: ModelCache | None = None, name: str = "embedding") -> DataFrame:
    return rows.withColumn(name, embedding(text, make)) if cache is None else cache.vectors(rows, text, make, name)
