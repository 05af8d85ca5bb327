"""Queries that reinforce what the next one reads, folded graph by graph.

Similarity does not depend on edges, and reinforcement only ever raises a weight between two
nodes that were results. So a result of any query of a cell is among the contenders: the nodes
that lead one of the two rankings of some query of the cell before it begins. Spark finds the
contenders and their scores; a fold per graph then takes the queries in order and adds what
the pairs of earlier results have gained. A cell holds a bounded number of steps, so the number
of jobs depends on the longest graph's questions only by the cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.config import DEFAULT, MemoryConfig
from engram.operators import graph as G
from engram.operators.retrieve import base_scores, contenders, spread
from engram.plans.state import kept

#: Steps of a graph that are folded together: a task holds so many times as many contenders as these have results.
CELL = 200


class Gains:
    """What pairs of a graph's nodes have gained so far, as sorted keys src * n + dst."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, n: int, c: MemoryConfig):
        self.n, self.c = n, c
        self.edges, place = np.unique(src * n + dst, return_inverse=True)
        self.weight = np.bincount(place, weights=weight, minlength=len(self.edges)) if len(src) else np.empty(0)
        self.keys, self.count, self.more = np.empty(0, np.int64), np.empty(0), np.empty(0)

    def boost(self, enh: np.ndarray) -> np.ndarray:
        """What each node gets on top of the spreading over the edges as they were."""
        src, dst = np.divmod(self.keys, self.n)
        flow = np.where(enh[src] > self.c.spread_threshold, enh[src] * self.more * self.c.alpha, 0.0)
        return np.bincount(dst, weights=flow, minlength=self.n)

    def add(self, results: list[np.ndarray]) -> None:
        """All pairs of each list of results, both ways."""
        new = [np.empty(0, np.int64)]
        for ids in results:
            a, b = np.meshgrid(ids, ids, indexing="ij")
            new.append((a * self.n + b)[a != b])
        keys = np.concatenate([self.keys, *new])
        counts = np.concatenate([self.count, np.ones(len(keys) - len(self.keys))])
        self.keys, place = np.unique(keys, return_inverse=True)
        self.count = np.bincount(place, weights=counts, minlength=len(self.keys))
        at = np.searchsorted(self.edges, self.keys)
        held = np.zeros(len(self.keys))
        if len(self.edges):
            found = self.edges[np.minimum(at, len(self.edges) - 1)] == self.keys
            held[found] = self.weight[at[found]]
        self.more = np.maximum(np.minimum(1.0, held + self.count * self.c.learning_rate) - np.minimum(1.0, held), 0.0)


def _leading(score: np.ndarray, seq: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((-seq, -np.round(score, 12)))[:k]


def folded(k: int, c: MemoryConfig):
    most = c.max_flipped if c.alpha > 0 else 0

    def work(rows: pa.Table, among: pa.Table) -> pa.Table:
        node, query = (rows.column(x).combine_chunks().dictionary_encode() for x in ("node_id", "query_id"))
        at, of, n, n_q = node.indices.to_numpy(), query.indices.to_numpy(), len(node.dictionary), len(query.dictionary)
        scores = {}
        for name in ("base", "enh", "fin"):
            scores[name] = np.full((n_q, n), -np.inf)
            scores[name][of, at] = rows.column(name).to_numpy()
        seq, step = np.zeros(n, np.int64), np.zeros(n_q, np.int64)
        seq[at], step[of] = rows.column("node_seq").to_numpy(), rows.column("qa_index").to_numpy()
        src, dst = (pc.index_in(among.column(x).combine_chunks(), value_set=node.dictionary).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("src", "dst"))
        gains, out = Gains(src, dst, among.column("weight").to_numpy(), n, c), []
        for now in np.unique(step):
            results = []
            for q in np.flatnonzero(step == now):  # questions with one number don't see each other
                enh = scores["enh"][q]
                fin = scores["fin"][q] + gains.boost(enh)
                first = _leading(enh, seq, k)
                lead = _leading(fin, seq, k)
                flipped = lead[~np.isin(lead, first)][:most]
                ids = np.concatenate([first, flipped])
                results.append(ids)
                out.append((np.full(len(ids), q), ids, np.arange(1, len(ids) + 1), fin[ids], scores["base"][q, ids], np.arange(len(ids)) >= len(first)))
            gains.add(results)
        q, ids, rank, fin, base, flipped = (np.concatenate(v) for v in zip(*out, strict=True))
        return pa.table({
            "query_id": query.dictionary.take(pa.array(q)), "graph_id": pa.repeat(rows.column("graph_id")[0], len(q)), "node_id": node.dictionary.take(pa.array(ids)),
            "out_rank": pa.array(rank, pa.int64()), "fin": pa.array(fin), "base": pa.array(base), "flipped": pa.array(flipped), "qa_index": pa.array(step[q]),
        })

    def apart(rows: pa.Table, among: pa.Table) -> pa.Table:
        if rows.num_rows:
            return work(rows, among)
        kinds = rows.schema
        return pa.table({**{x: pa.array([], kinds.field(x).type) for x in ("query_id", "graph_id", "node_id")}, "out_rank": pa.array([], pa.int64()),
                         "fin": pa.array([], pa.float64()), "base": pa.array([], pa.float64()), "flipped": pa.array([], pa.bool_()), "qa_index": pa.array([], pa.int64())})

    return apart


def sequential(nodes: DataFrame, edges: DataFrame, queries: DataFrame, k: int = DEFAULT.top_k, c: MemoryConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(results, gains): each query of a graph, in order of qa_index, reinforces what the next one reads.

    gains: graph_id, src, dst, weight, what ``graph.upsert`` adds to the edges. Queries of a graph with
    one qa_index don't see each other. Nodes without a vector are never results. A cell is a few
    jobs, whatever the number of its questions and graphs; the gains of earlier cells are summed.
    """
    nodes = nodes.where("embedding IS NOT NULL")
    at = F.dense_rank().over(Window.partitionBy("graph_id").orderBy("qa_index"))
    dealt = kept(queries.withColumns({"qa_index": F.col("qa_index").cast("long"), "_cell": F.floor((at - 1) / F.lit(CELL)).cast("int")}))
    cells = dealt.agg(F.max("_cell")).first()[0]
    kind = {f.name: f.dataType.simpleString() for f in [*nodes.schema, *queries.schema]}
    schema = f"query_id {kind['query_id']}, graph_id {kind['graph_id']}, node_id {kind['node_id']}, out_rank long, fin double, base double, flipped boolean, qa_index long"
    out, gained = None, None
    for cell in range((cells if cells is not None else 0) + 1):
        asked = dealt.where(F.col("_cell") == cell).drop("_cell")
        graphs = asked.select("graph_id").distinct()
        now = edges.join(graphs, "graph_id", "left_semi") if cell else edges
        if gained is not None:
            now = G.upsert(now, gained.join(graphs, "graph_id", "left_semi"))
        own = nodes.join(graphs, "graph_id", "left_semi") if cell else nodes
        lead = kept(contenders(own, now, asked, k, c))
        into = now.join(lead.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_semi")
        needed = lead.unionByName(into.select("graph_id", F.col("src").alias("node_id")))
        near = own.join(needed, ["graph_id", "node_id"], "left_semi")
        rows = spread(base_scores(near, asked, c), into, c).join(lead, ["graph_id", "node_id"], "left_semi")
        rows = rows.select("graph_id", "query_id", "qa_index", "node_id", F.col("node_seq").cast("long").alias("node_seq"), "base", "enh", "fin")
        among = into.join(lead.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi").select(F.col("graph_id").alias("of_graph"), "src", "dst", "weight")
        found = rows.groupBy("graph_id").cogroup(among.groupBy("of_graph")).applyInArrow(folded(k, c), schema)
        res = kept(found.select("query_id", "graph_id", "node_id", "out_rank", F.round("fin", 9).alias("score"), F.round("base", 9).alias("base_score"), "flipped",
                                F.when(F.col("flipped"), "spreading").otherwise("base").alias("source"), "qa_index"))
        more = G.reinforce_pairs(res, c.learning_rate)
        gained = more if gained is None else kept(gained.unionByName(more).groupBy("graph_id", "src", "dst").agg(F.sum("weight").alias("weight")))
        out = res if out is None else out.unionByName(res)
    return out, gained
