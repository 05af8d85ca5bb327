"""Profiles, retained knowledge, keywords and the search of knowledge."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.config import DEFAULT, MemoryConfig
from engram.functions.models import completion
from engram.functions.prompts import KEYWORDS, about
from engram.functions.text import direction, dot, frequent, keywords, strip, tokens
from engram.operators.retrieve import retrieve

UPDATED = "\n\n--- Updated ---\n"  # a fixed value


def with_keywords(rows: DataFrame, text: str, most: int = 3, name: str = "keywords") -> DataFrame:
    """The most frequent tokens; ties in alphabetical order."""
    return rows.withColumn(name, frequent(tokens(F.coalesce(F.col(text), F.lit(""))), most))


def with_model_keywords(rows: DataFrame, text: str, make, name: str = "keywords") -> DataFrame:
    """The keywords that a text model names, however many; none where it fails."""
    return rows.withColumn(name, keywords(completion(about(KEYWORDS, F.coalesce(F.col(text), F.lit(""))), make)))


def fold_profiles(updates: DataFrame, key: str, order: list[Column], data: str, merge: Column) -> DataFrame:
    """One profile a key: a replacing update drops what came before it, a merging one is appended."""
    by = Window.partitionBy(key)
    upto = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    u = updates.withColumns({"_era": F.sum((~merge).cast("int")).over(upto), "_n": F.row_number().over(by.orderBy(*order))})
    last = u.withColumn("_last", F.max("_era").over(by)).where("_era = _last")
    parts = last.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", F.col(data).alias("d")))).alias("l"))
    return parts.select(key, F.array_join(F.transform("l", lambda x: x["d"]), UPDATED).alias("data"))


def stated(c: Column) -> Column:
    """False for texts that state nothing."""
    return ~strip(F.coalesce(c, F.lit(""))).isin("", "- None", "- None.")


def retain(rows: DataFrame, key: str, order: list[Column], most: int = 100) -> DataFrame:
    """The newest rows of each key; order goes from the newest on."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def latest(updates: DataFrame, key: str, order: list[str], data: str = "data") -> DataFrame:
    """One profile a key: the last update replaces those before it."""
    return updates.groupBy(key).agg(F.max_by(data, F.struct(*order)).alias(data))


def profile_of(keys: DataFrame, profiles: DataFrame, key: str, data: str = "data") -> DataFrame:
    """Each key with its profile's text, empty where it has none."""
    return keys.join(profiles.select(key, data), key, "left").withColumn(data, F.coalesce(data, F.lit("")))


def add_assistant_knowledge(stored: DataFrame, new: DataFrame, most: int = 100) -> DataFrame:
    """The stored rows (graph_id, ak_seq, knowledge, ts, embedding) and new ones behind them; a graph keeps its newest ``most``.

    New rows have an ak_seq among themselves and go on from the graph's last one; texts that state nothing are left out.
    """
    last = stored.groupBy("graph_id").agg(F.max("ak_seq").alias("last"))
    order = F.row_number().over(Window.partitionBy("graph_id").orderBy("ak_seq"))
    added = new.where(stated(F.col("knowledge"))).withColumn("k", order).join(last, "graph_id", "left")
    added = added.withColumn("ak_seq", (F.coalesce("last", F.lit(-1)) + F.col("k")).cast("long")).select(*stored.columns)
    return retain(stored.unionByName(added), "graph_id", [F.desc("ak_seq")], most)


def contents(nodes: DataFrame) -> DataFrame:
    """The knowledge texts of all nodes."""
    return nodes.select("graph_id", "node_id", F.col("content").alias("knowledge"))


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Plain cosine top-k within a graph; ties go to the lower node_seq."""
    unit = rows.where("embedding IS NOT NULL").withColumn("embedding", direction(F.col("embedding")))
    s = unit.join(queries.withColumn("q_embedding", direction(F.col("q_embedding"))), "graph_id")
    s = s.withColumn("sim", dot(F.col("embedding"), F.col("q_embedding"))).drop("embedding", "q_embedding")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("sim", 12).desc(), "node_seq"))
    s = s.withColumn("out_rank", rank).where(F.col("out_rank") <= k)
    return s.select("query_id", "graph_id", "node_id", F.col("out_rank").cast("long").alias("out_rank"), F.round("sim", 9).alias("score"))


def search_knowledge(nodes: DataFrame, edges: DataFrame, fallback: DataFrame, queries: DataFrame, k: int = DEFAULT.kb_top_k, c: MemoryConfig = DEFAULT) -> DataFrame:
    """Retrieval where a graph has knowledge nodes; plain similarity over the fallback rows where it has none."""
    found = retrieve(nodes, edges, queries, k, c).select("query_id", "graph_id", "node_id", "out_rank", "score")
    rest = queries.join(nodes.select("graph_id").distinct(), "graph_id", "left_anti")
    return found.withColumn("origin", F.lit("graph")).unionByName(nearest(fallback, rest, k).withColumn("origin", F.lit("fallback")))
