"""Scoring, one-hop spreading and the two rankings of retrieval, as one lazy plan."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.config import DEFAULT, MemoryConfig
from engram.functions.text import dot, keyword_score, time_decay


#: Parts of a graph's nodes, each of which meets the graph's queries in a task of its own.
PARTS = 16


def base_scores(nodes: DataFrame, queries: DataFrame, c: MemoryConfig = DEFAULT) -> DataFrame:
    """Similarity rescaled to 0..1 and the enhanced score; queries meet the nodes of their graph only.

    With ``decay_mode`` "exponential" the enhanced score decays with the time from a node's ts to the query's
    ``asked_at`` (a timestamp); by default it does not. A graph's nodes are dealt into parts, so that a large
    graph isn't one join key; queries go to every part.
    """
    dealt = nodes.withColumn("_part", F.pmod(F.xxhash64("node_id"), F.lit(PARTS)))
    asked = queries.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    s = dealt.join(asked, ["graph_id", "_part"]).drop("_part").withColumn("base", (dot(F.col("embedding"), F.col("q_embedding")) + 1) / 2)
    kw = keyword_score(F.col("q_keywords"), F.col("keywords")) if c.use_keywords and "q_keywords" in queries.columns else F.lit(0.0)
    enh = F.col("base") + F.lit(c.keyword_weight) * kw
    if c.decay_mode == "exponential":
        enh = enh * time_decay(F.col("ts"), F.col("asked_at"), c.tau)
    return s.withColumn("enh", enh).drop("embedding", "q_embedding")


def boosts(scores: DataFrame, edges: DataFrame, c: MemoryConfig = DEFAULT) -> DataFrame:
    """Per query and target: the sum of alpha * enh * weight over sources strictly above the threshold."""
    src = scores.where(F.col("enh") > c.spread_threshold).select("graph_id", "query_id", F.col("node_id").alias("src"), F.col("enh").alias("se"))
    return src.join(edges, ["graph_id", "src"]).groupBy("query_id", F.col("dst").alias("node_id")).agg(F.sum(F.col("se") * F.col("weight") * F.lit(c.alpha)).alias("boost"))


def spread(scores: DataFrame, edges: DataFrame, c: MemoryConfig = DEFAULT) -> DataFrame:
    """fin = enh + boost."""
    scored = scores.join(boosts(scores, edges, c), ["query_id", "node_id"], "left")
    return scored.withColumn("fin", F.col("enh") + F.coalesce("boost", F.lit(0.0)))


def ranking(score: str):
    """Places of a query's nodes by a score; ties go to the later node."""
    return F.row_number().over(Window.partitionBy("query_id").orderBy(F.round(score, 12).desc(), F.col("node_seq").desc()))


def _tops(nodes: DataFrame, edges: DataFrame, queries: DataFrame, k: int, c: MemoryConfig) -> tuple[DataFrame, DataFrame]:
    """The k leading rows of each ranking, with br or sr as the place."""
    s = spread(base_scores(nodes, queries, c), edges, c).select("query_id", "graph_id", "node_id", "node_seq", "base", "enh", "fin")
    base = s.withColumn("br", ranking("enh")).where(F.col("br") <= k).withColumn("sr", F.lit(None).cast("int"))
    return base, s.withColumn("sr", ranking("fin")).where(F.col("sr") <= k).withColumn("br", F.lit(None).cast("int"))


def contenders(nodes: DataFrame, edges: DataFrame, queries: DataFrame, k: int = DEFAULT.top_k, c: MemoryConfig = DEFAULT) -> DataFrame:
    """(graph_id, node_id): the nodes that are among the first k of a ranking of any of the graph's queries."""
    base, top = _tops(nodes, edges, queries, k, c)
    return base.unionByName(top).select("graph_id", "node_id").distinct()


def retrieve(nodes: DataFrame, edges: DataFrame, queries: DataFrame, k: int = DEFAULT.top_k, c: MemoryConfig = DEFAULT) -> DataFrame:
    """Base top-k, then those of the spread top-k that it lacks, at most max_flipped.

    Each ranking is cut to k rows a query on its own, so that Spark can cut them before the shuffle,
    too; what follows handles 2 k rows a query.
    """
    base, top = _tops(nodes, edges, queries, k, c)
    same = Window.partitionBy("query_id", "node_id")
    by = Window.partitionBy("query_id")
    both = base.unionByName(top).withColumn("in_base", F.max("br").over(same).isNotNull())
    both = both.where(F.col("br").isNotNull() | ~F.col("in_base")).withColumn("flipped", F.col("br").isNull())
    both = both.withColumns({"fr": F.row_number().over(by.orderBy(F.col("sr").asc_nulls_last())), "nb": F.count("br").over(by)})
    most = c.max_flipped if c.alpha > 0 else 0
    both = both.where(~F.col("flipped") | (F.col("fr") <= most))
    return both.select("query_id", "graph_id", "node_id", F.when(F.col("flipped"), F.col("nb") + F.col("fr")).otherwise(F.col("br")).cast("long").alias("out_rank"),
                       F.round("fin", 9).alias("score"), F.round("base", 9).alias("base_score"), "flipped", F.when(F.col("flipped"), "spreading").otherwise("base").alias("source"))


def context(results: DataFrame, contents: DataFrame, c: MemoryConfig = DEFAULT) -> DataFrame:
    """Ordered blocks with their label, joined by a blank line."""
    r = results if c.flipped_in_context else results.where("NOT flipped")
    label = F.when(F.col("base_score") > 0.6, "direct").otherwise("associative")
    line = F.concat(F.lit("["), label, F.lit("] "), "content")
    blocks = r.join(contents, ["graph_id", "node_id"]).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("out_rank", line.alias("line")))).alias("l"))
    return blocks.select("query_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("context"))
