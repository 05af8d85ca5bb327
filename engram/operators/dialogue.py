"""Turn pairing, memory nodes and buffers."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_adjacent(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """User rows directly followed by an assistant row."""
    w = Window.partitionBy(*keys).orderBy(order)
    nxt = rows.withColumns({"next_role": F.lead("role").over(w), "ai_text": F.lead("text").over(w)})
    return nxt.where("role = 'user' AND next_role = 'assistant'").withColumnRenamed("text", "user_text").drop("role", "next_role")


def pair_fifo(rows: DataFrame, keys: list[str], order: list[Column], user: Column, ident: str) -> DataFrame:
    """Replies take the oldest waiting user row of their session; without one they are dropped."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    prior = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    r = rows.withColumn("u", user).withColumn("s", F.sum(F.when(F.col("u"), 1).otherwise(-1)).over(upto))
    r = r.withColumn("m", F.least(F.lit(0), F.coalesce(F.min("s").over(prior), F.lit(0))))
    r = r.withColumn("hit", ~F.col("u") & (F.col("s") >= F.col("m")))
    r = r.withColumns({"un": F.sum(F.col("u").cast("int")).over(upto), "rn": F.sum(F.col("hit").cast("int")).over(upto)})
    asks = r.where("u").select(*keys, F.col("un").alias("turn_seq"), F.col(ident).alias("user_row"))
    replies = r.where("hit").select(*keys, F.col("rn").alias("turn_seq"), F.col(ident).alias("reply_row"))
    return asks.join(replies, [*keys, "turn_seq"])


def memory_nodes(turns: DataFrame, key: str, order: str, *more: str) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    content = F.concat(F.lit("User: "), "user_text", F.lit("\nAI: "), "ai_text")
    return turns.select(F.col(key).alias("graph_id"), seq.cast("long").alias("node_seq"), content.alias("content"), F.lit("interaction").alias("role"), *more)


def buffers(turns: DataFrame, key: str, order: str, size: int = 10) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return turns.withColumn("seq", seq).groupBy(key, F.floor((F.col("seq") - 1) / size).cast("long").alias("batch")).agg(F.count("*").alias("n_turns"))
