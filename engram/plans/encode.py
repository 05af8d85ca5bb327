"""From conversation logs to memory graphs and extracted knowledge."""

import hashlib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.config import DEFAULT, MemoryConfig
from engram.functions import prompts as P
from engram.functions.models import Encoder, TextModel, completion, extractive_model, hashed_encoder
from engram.functions.text import clean_line, fact_line, lines, strip
from engram.operators import dialogue as D
from engram.operators import graph as G
from engram.operators.knowledge import stated, with_keywords, with_model_keywords
from engram.plans.cache import ModelCache, with_replies, with_vectors
from engram.plans.state import kept
from engram.sources.segments import Segments
from engram.sources.store import dialogs

Make = Callable[[], TextModel]


def item_turns(items: DataFrame, now: Column | None = None) -> DataFrame:
    """Turns of session lists: a user row directly followed by an assistant row. A session without a date gets ``now``, null where none is given."""
    s = items.select(F.col("question_id").alias("graph_id"), "haystack_dates", F.posexplode("haystack_sessions").alias("session_seq", "rows"))
    s = s.withColumn("ts", F.coalesce(F.get("haystack_dates", F.col("session_seq")), F.lit(None).cast("string") if now is None else now))
    rows = s.select("graph_id", "session_seq", "ts", F.posexplode("rows").alias("pos", "r")).select("*", "r.role", F.col("r.content").alias("text")).drop("r")
    return D.pair_adjacent(rows, ["graph_id", "session_seq"], "pos").select("graph_id", "session_seq", F.col("pos").alias("turn_seq"), "ts", "user_text", "ai_text")


def sample_turns(samples: DataFrame) -> DataFrame:
    """Turns of two-speaker samples: a reply takes the oldest waiting utterance of its session."""
    rows, keys = dialogs(samples), ["sample_id", "session_seq"]
    pairs = D.pair_fifo(rows, keys, [F.col("pos")], F.col("is_user"), "pos")
    asks = rows.select(*keys, F.col("pos").alias("user_row"), "ts", F.col("text").alias("user_text"))
    replies = rows.select(*keys, F.col("pos").alias("reply_row"), F.col("text").alias("ai_text"))
    out = pairs.join(asks, [*keys, "user_row"]).join(replies, [*keys, "reply_row"])
    return out.select(F.col("sample_id").alias("graph_id"), "session_seq", "turn_seq", "ts", "user_text", "ai_text")


def memory_graph(turns: DataFrame, make: Callable[[], Encoder] = hashed_encoder, keyword_model: Make | None = None, cache: ModelCache | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes with vectors and keywords, and the edges between following nodes. Identifiers are the order in the graph.

    Keywords are the most frequent words, unless a model is given to name them.
    """
    t = turns.withColumn("order", F.struct("session_seq", "turn_seq"))
    nodes = D.memory_nodes(t, "graph_id", "order", "ts").withColumn("node_id", F.col("node_seq"))
    named = with_model_keywords(nodes, "content", keyword_model) if keyword_model else with_keywords(nodes, "content")
    return with_vectors(named, F.col("content"), make, cache), G.temporal_edges(nodes)


def batch_texts(turns: DataFrame, key: str, order: str, c: MemoryConfig = DEFAULT) -> DataFrame:
    """The text of each buffer of turns, in order; the last buffer of a key may be short."""
    nodes = D.memory_nodes(turns, key, order)
    batch = F.floor(F.col("node_seq") / c.buffer_turns).cast("long").alias("batch")
    lines = nodes.groupBy("graph_id", batch).agg(F.array_sort(F.collect_list(F.struct("node_seq", "content"))).alias("l"))
    return lines.select("graph_id", "batch", F.array_join(F.transform("l", lambda x: x["content"]), "\n").alias("text"))


def extract(batches: DataFrame, make: Make = extractive_model, cache: ModelCache | None = None) -> DataFrame:
    """Per buffer: profile, private facts and assistant facts as the model replies.

    A profile reply without the marker has no private part ("None"); one with several markers loses its whole buffer.
    """
    rows = with_replies(batches.select("graph_id", "batch", "text"), P.about(P.PROFILE.format(marker=P.MARKER), F.col("text")), make, cache, "r")
    rows = with_replies(rows, P.about(P.TRAITS, F.col("text")), make, cache, "t")
    r = rows.select("graph_id", "batch", F.col("r.reply").alias("r"), F.col("t.reply").alias("assistant"))
    r = r.withColumn("p", split_reply(F.col("r"), P.MARKER)).where("NOT p.failed")
    return r.select("graph_id", "batch", strip(F.col("p.profile")).alias("profile"), strip(F.col("p.private")).alias("private"), "assistant")


def split_reply(reply: Column, marker: str) -> Column:
    """(profile, private, failed) of a reply: cut at the marker; without it there is nothing private, with several the reply has failed."""
    parts = F.split(reply, re.sub(r"([\[\]])", r"\\\1", marker))
    n = F.size(parts)
    private = F.when(n == 1, "None").when(n == 2, F.get(parts, F.lit(1)))
    return F.struct(F.when(n <= 2, parts[0]).alias("profile"), private.alias("private"), (n > 2).alias("failed"))


def facts(extracted: DataFrame, column: str, whole: bool = False) -> DataFrame:
    """Clean lines of private or assistant facts; lines that state nothing go.

    ``whole``: as the session-list style has it, a text that is "none" as a whole goes first, and only line feeds end a line.
    """
    rows, text = extracted, strip(F.coalesce(F.col(column), F.lit("")))
    if whole:
        rows = rows.where(~F.lower(text).isin("", "none", "- none"))
    cut = F.split(column, "\n") if whole else lines(F.col(column))
    rows = rows.select("graph_id", "batch", F.posexplode(cut).alias("line_no", "raw"))
    return rows.withColumn("content", clean_line(F.col("raw"))).where(F.col("content").isNotNull() & stated(F.col("content"))).drop("raw")


def knowledge_graph(found: DataFrame, order: list[str], ts: Column | None = None, make: Callable[[], Encoder] = hashed_encoder, cache: ModelCache | None = None) -> tuple[DataFrame, DataFrame]:
    """Facts (graph_id, content) as nodes of a knowledge graph, in that order, and the edges between following ones."""
    seq = (F.row_number().over(Window.partitionBy("graph_id").orderBy(*order)) - 1).cast("long")
    nodes = found.select("graph_id", seq.alias("node_seq"), seq.alias("node_id"), "content", F.lit("system").alias("role"), (F.lit(None).cast("string") if ts is None else ts).alias("ts"))
    nodes = nodes.withColumn("metadata", F.create_map(F.lit("type"), F.lit("fact")))
    return with_vectors(with_keywords(nodes, "content"), F.col("content"), make, cache), G.temporal_edges(nodes)


#: Batches of a graph that are folded in one task, between two stores of the progress.
FOLD = 50
PROGRESS = {"folds": "graph_id {key}, batch LONG, digest STRING, data STRING"}


def _fold(make: Make, end: int | None = None):
    """Goes on with a graph's profile, up to the batch before ``end``. Rows: batch, profile and, from an earlier chunk or run, state (digest of all it has folded, and the profile)."""

    def chain(digest: str, text: str) -> str:
        return hashlib.sha256(f"{digest}\0{text}".encode()).hexdigest()

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("batch", kind="stable")
        held = rows[rows["digest"].notna()]
        state = (held["batch"].iloc[-1], held["digest"].iloc[-1], held["data"].iloc[-1]) if len(held) else None
        rows, model, profile, digest, last = rows[rows["digest"].isna()], make(), "", "", -2
        done = ""
        for batch, new in zip(rows["batch"], rows["profile"], strict=True):
            done = chain(done, new) if state and batch <= state[0] else done
        begin = -2
        if state and done == state[1]:  # what it has folded is what these batches are
            begin, digest, profile = state
            last = begin
        for batch, new in zip(rows["batch"], rows["profile"], strict=True):
            if batch > begin and (end is None or batch < end):
                profile = model(f"{P.MERGE}\n\n{P.MATERIAL}\n{profile}\n{new}") if profile else new
                digest, last = chain(digest, new), batch
        return pd.DataFrame({"graph_id": rows["graph_id"].iloc[:1], "batch": [last], "digest": [digest], "data": [profile]})

    return fold


def fold_extracted(extracted: DataFrame, make: Make = extractive_model, stored: DataFrame | None = None, progress: Segments | None = None) -> DataFrame:
    """One profile per graph (graph_id, data), going on from the stored one where there is one.

    Each step needs the one before, so a graph's short profile texts are folded in one task. With ``progress``,
    a store of ``PROGRESS``, it is FOLD batches at a time, and each chunk's state is stored: a run that fails goes on where it
    stopped, as long as the batches it has folded are the same, and does not call the model for them again.
    """
    kind = extracted.schema["graph_id"].dataType.simpleString()
    rows = extracted.select("graph_id", F.col("batch").cast("long").alias("batch"), "profile")
    if stored is not None:
        rows = rows.unionByName(stored.select("graph_id", F.lit(-1).cast("long").alias("batch"), F.col("data").alias("profile")))
    rows = rows.withColumns({"digest": F.lit(None).cast("string"), "data": F.lit(None).cast("string")})
    shape = f"graph_id {kind}, batch long, digest string, data string"
    if progress is None:
        return rows.groupBy("graph_id").applyInPandas(_fold(make), shape).select("graph_id", "data")
    rows = kept(rows)
    graphs = rows.select("graph_id").distinct()
    most = rows.agg(F.max("batch")).first()[0]
    for end in range(FOLD, (most if most is not None else -1) + FOLD + 1, FOLD):
        known = progress.read("folds").join(graphs, "graph_id", "left_semi").withColumn("profile", F.lit(None).cast("string"))
        begun = rows.where(F.col("batch") >= end - FOLD).select("graph_id").distinct() if end > FOLD else graphs
        state = rows.unionByName(known).join(begun, "graph_id", "left_semi").groupBy("graph_id").applyInPandas(_fold(make, end), shape)
        progress.commit({"folds": state}, graphs=begun)
    return progress.read("folds").join(graphs, "graph_id", "left_semi").select("graph_id", "data")


def cluster_texts(nodes: DataFrame, edges: DataFrame, c: MemoryConfig = DEFAULT) -> DataFrame:
    """Texts of the clusters of graphs with three nodes or more; clusters with fewer than two texts go."""
    large = nodes.groupBy("graph_id").agg(F.count("*").alias("n")).where("n >= 3").select("graph_id")
    nodes = nodes.join(large, "graph_id", "left_semi")
    edges = edges.join(large, "graph_id", "left_semi").select("graph_id", "src", "dst", "weight")
    e = edges.unionByName(G.similarity_edges(nodes.where("embedding IS NOT NULL"), edges, c))
    clusters = G.greedy_clusters(G.hubs(G.degrees(nodes, e), c), e.withColumn("edge_seq", F.col("dst")), c)
    rows = clusters.select("graph_id", "hub", F.posexplode("members").alias("pos", "node_id"))
    texts = rows.join(nodes.where("content <> ''").select("graph_id", "node_id", F.substring("content", 1, 1500).alias("c")), ["graph_id", "node_id"])
    out = texts.groupBy("graph_id", "hub").agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("l")).where(F.size("l") >= 2)
    return out.select("graph_id", "hub", F.array_join(F.transform("l", lambda x: x["c"]), "\n\n---\n\n").alias("text"))


def consolidate(nodes: DataFrame, edges: DataFrame, make: Make = extractive_model, c: MemoryConfig = DEFAULT) -> DataFrame:
    """Facts that the model finds in clusters, a row each."""
    r = cluster_texts(nodes, edges, c).select("graph_id", "hub", completion(P.about(P.FACTS, F.col("text")), make).alias("r"))
    rows = r.select("graph_id", "hub", F.posexplode(F.split("r", "\n")).alias("line_no", "raw"))
    return rows.withColumn("content", fact_line(F.col("raw"))).where("content IS NOT NULL").drop("raw")


def additions(stored: tuple[DataFrame, DataFrame], new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges that come on top when new nodes go behind the stored ones. Identifiers go on from the graph's last one and are never used again.

    New nodes have a node_seq among themselves; the first is linked to the graph's last stored node.
    Columns that the new nodes lack are null, others are left out.
    """
    nodes = stored[0]
    last = nodes.groupBy("graph_id").agg(F.max("node_seq").alias("last"))
    seq = (F.col("node_seq") + F.coalesce(F.col("last") + 1, F.lit(0))).cast("long")
    added = new.join(last, "graph_id", "left").withColumns({"node_seq": seq, "node_id": seq})
    ends = last.join(new.select("graph_id").distinct(), "graph_id", "left_semi").select("graph_id", F.col("last").alias("node_seq"))
    chain = ends.unionByName(added.select("graph_id", "node_seq")).withColumn("node_id", F.col("node_seq"))
    added = added.select(*[F.col(f.name) if f.name in added.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in nodes.schema])
    return added, G.temporal_edges(chain)


def append(stored: tuple[DataFrame, DataFrame], new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored nodes and edges with new nodes behind them; stored edges keep their weights."""
    nodes, edges = additions(stored, new)
    return stored[0].unionByName(nodes), stored[1].unionByName(edges)


def remember(stored: tuple[DataFrame, DataFrame], turns: DataFrame, make: Callable[[], Encoder] = hashed_encoder) -> tuple[DataFrame, DataFrame]:
    """A stored graph with further turns of its dialogue."""
    return append(stored, memory_graph(turns, make)[0])


def new_knowledge(stored: tuple[DataFrame, DataFrame], found: DataFrame, ts: Column, make: Callable[[], Encoder] = hashed_encoder) -> tuple[DataFrame, DataFrame]:
    """The knowledge nodes and edges that the facts (graph_id, hub, line_no, content) make behind the stored ones."""
    return additions(stored, knowledge_graph(found, ["hub", "line_no"], ts, make)[0])
