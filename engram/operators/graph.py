"""Edges: making, reinforcing, decay, similarity, degrees, hubs, clusters and forgetting."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.config import DEFAULT, MemoryConfig
from engram.functions.text import direction, dot
from engram.plans.state import kept


def both_ways(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def temporal_edges(nodes: DataFrame) -> DataFrame:
    prev = F.lag("node_id").over(Window.partitionBy("graph_id").orderBy("node_seq"))
    e = nodes.select("graph_id", prev.alias("src"), F.col("node_id").alias("dst"), F.lit(0.5).alias("weight"))
    return both_ways(e.where("src IS NOT NULL"))


def upsert(edges: DataFrame, deltas: DataFrame) -> DataFrame:
    """Adds deltas in both directions; weights stop at 1; self-loops are ignored."""
    total = edges.unionByName(both_ways(deltas.where("src <> dst")))
    return total.groupBy("graph_id", "src", "dst").agg(F.least(F.lit(1.0), F.sum("weight")).alias("weight"))


def reinforce_pairs(results: DataFrame, rate: float = DEFAULT.learning_rate) -> DataFrame:
    a, b = results.select("query_id", "graph_id", F.col("node_id").alias("src"), F.col("out_rank").alias("i")), results.select("query_id", F.col("node_id").alias("dst"), F.col("out_rank").alias("j"))
    return a.join(b, "query_id").where("i < j").groupBy("graph_id", "src", "dst").agg((F.count("*") * F.lit(rate)).alias("weight"))


def decay(edges: DataFrame, rate: float = DEFAULT.decay_rate, floor: float = 0.01) -> DataFrame:
    return edges.withColumn("weight", F.col("weight") * F.lit(rate)).where(F.col("weight") >= floor)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = edges.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count("*").alias("degree"), F.sum("weight").alias("total_weight"))
    return nodes.select("graph_id", "node_id", "node_seq").join(d, ["graph_id", "node_id"], "left").fillna(0, ["degree", "total_weight"])


#: Nodes of a graph in a cell of the similarity join, about.
CELL_NODES = 2_000
#: Parts in which a large graph's nodes look for their pivots.
PARTS = 64
#: Rings of nodes around a pivot, of equal width.
RINGS = 16
#: Blocks of neighbouring cells in a large graph, as long as a block's vectors take no more than so many bytes as doubles.
BLOCKS, BLOCK_BYTES = 4, 16 << 20
#: Nodes of a block that are compared at a time, and with how many.
TILE, COLUMNS = 256, 4_096
#: Similarities are ranked to twelve decimals.
DECIMALS = 1e12


def unit_vectors(column: pa.ChunkedArray) -> np.ndarray:
    """A row for each vector, of length 1 (zero vectors stay); vectors of several lengths are refused."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    if len(sizes) and sizes.min() != sizes.max():
        raise ValueError(f"vectors of a graph have one length, but here are {sizes.min()} and {sizes.max()}")
    e = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1)
    e /= np.maximum(np.sqrt(np.einsum("ij,ij->i", e, e)), 1e-10)[:, None]
    return e


class _Best:
    """The ``most`` best partners above the cutoff of each of n nodes, from pairs offered piece by piece: of equal similarity those that come last in the graph."""

    def __init__(self, seq: np.ndarray, most: int, cutoff: float):
        self.node_seq, self.most, self.cutoff = seq, most, cutoff
        self.key = np.full((len(seq), most), -np.inf)
        self.sim, self.seq, self.at = np.zeros((len(seq), most)), np.zeros((len(seq), most), np.int64), np.zeros((len(seq), most), np.int64)
        self.floor = np.full(len(seq), cutoff)  # no less similar pair is taken

    def offer(self, i: np.ndarray, j: np.ndarray, sim: np.ndarray) -> None:
        key, seq = np.rint(sim * DECIMALS), self.node_seq[j]
        last, last_seq = self.key[i, -1], self.seq[i, -1]
        keep = (i != j) & ((key > last) | ((key == last) & (seq > last_seq)))
        if not keep.any():
            return
        i, rows = i[keep], np.unique(i[keep])
        new = [key[keep], seq[keep], sim[keep], j[keep]]
        of = np.append(i, np.repeat(rows, self.most))
        key, seq, sim, at = (np.append(v, held[rows].ravel()) for v, held in zip(new, (self.key, self.seq, self.sim, self.at), strict=True))
        order = np.lexsort((-seq, -key, of))
        start = np.searchsorted(of[order], rows)
        best = order[start[:, None] + np.arange(self.most)]
        self.key[rows], self.seq[rows], self.sim[rows], self.at[rows] = key[best], seq[best], sim[best], at[best]
        self.floor[rows] = np.maximum(self.cutoff, self.key[rows, -1] / DECIMALS - 1e-11)


def _shells(e: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of nodes a direction, and the least and largest angle to it; where the vectors cancel out, all angles are possible."""
    centre = np.add.reduceat(e, edges[:-1], axis=0)
    long = np.sqrt((centre * centre).sum(1))
    centre /= np.maximum(long, 1e-10)[:, None]
    angle = [np.arccos(np.clip(e[a:z] @ c, -1, 1)) for a, z, c in zip(edges[:-1], edges[1:], centre, strict=True)]
    sound = long > 1e-6
    return centre, np.where(sound, [v.min() for v in angle], 0.0), np.where(sound, [v.max() for v in angle], np.pi)


def _tiles_near(e: np.ndarray, edges: np.ndarray, cutoff: float) -> np.ndarray:
    """Which pairs of tiles may hold nodes more similar than the cutoff, by the same bounds as in ``cell_pairs``."""
    if cutoff < 0:
        return np.ones((len(edges) - 1, len(edges) - 1), bool)
    centre, inner, radius = _shells(e, edges)
    between = np.arccos(np.clip(centre @ centre.T, -1, 1))
    apart = np.maximum(between - radius[:, None] - radius, np.maximum(inner[:, None] - between - radius, inner - between - radius[:, None]))
    return ~(apart > np.arccos(min(cutoff, 1.0)) + 1e-6)  # entries that are no numbers skip nothing


def _spans(edges: np.ndarray, wanted: np.ndarray):
    """(first, end) of the nodes of wanted tiles; neighbouring tiles go together up to COLUMNS nodes."""
    first = end = -1
    for t in wanted.tolist():
        a, z = int(edges[t]), int(edges[t + 1])
        if a == end and z - first <= COLUMNS:
            end = z
            continue
        if end > first:
            yield first, end
        first, end = a, z
    if end > first:
        yield first, end


def _near(most: int, cutoff: float):
    """For the nodes of a pair of blocks: each node's best partners above the cutoff, at most ``most`` a node whatever the number of ties.

    Blocks are compared tile by tile, tiles that are too far apart are skipped: beside the vectors, memory is that of a tile by COLUMNS.
    """

    def work(table: pa.Table) -> pa.Table:
        second, cell = (table.column(c).to_numpy(zero_copy_only=False) for c in ("second", "cell"))
        seq = table.column("node_seq").combine_chunks().fill_null(-(1 << 62)).to_numpy(zero_copy_only=False)
        order = np.lexsort((-seq, cell, second))
        e, second, cell = unit_vectors(table.column("e"))[order], second[order], cell[order]
        runs = np.append(np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (second[1:] != second[:-1]))), len(e))
        edges = np.concatenate([*[np.arange(a, z, TILE) for a, z in zip(runs[:-1], runs[1:], strict=True)], [len(e)]])
        near, best = _tiles_near(e, edges, cutoff), _Best(seq[order], most, cutoff)
        tiles = np.arange(len(edges) - 1)
        other = second[edges[:-1]]
        for t in tiles[~other]:
            a, z = int(edges[t]), int(edges[t + 1])
            partners = tiles[near[t] & (other if other.any() else tiles >= t)]
            for b, y in _spans(edges, partners):
                sims = e[a:z] @ e[b:y].T
                i, j = np.nonzero(sims > best.floor[a:z, None])
                best.offer(a + i, b + j, sims[i, j])
                apart = sims[:, max(0, z - b) :]  # the tile itself is settled by its rows
                i, j = np.nonzero(apart > best.floor[None, max(z, b) : y])
                best.offer(max(z, b) + j, a + i, apart[i, j])
        i, k = np.nonzero(best.key > -np.inf)
        src, dst = pa.array(order[i]), pa.array(order[best.at[i, k]])
        ids = table.column("node_id")
        return pa.table({"graph_id": table.column("graph_id").take(src), "src": ids.take(src), "dst": ids.take(dst), "dseq": table.column("node_seq").take(dst), "sim": pa.array(best.sim[i, k])})

    return work


def _to_pivots(nodes: pa.Table, pivots: pa.Table) -> pa.Table:
    """Each node with its nearest pivot and the angle between them."""
    if not nodes.num_rows:
        return pa.table({**{x: nodes.column(x) for x in ("graph_id", "node_id", "node_seq", "e")}, "pivot": pa.array([], pa.int32()), "angle": pa.array([], pa.float64())})
    order = np.argsort(pivots.column("pivot").to_numpy())
    e, p = unit_vectors(nodes.column("e")), unit_vectors(pivots.column("pe"))[order]
    which, sim = np.empty(len(e), np.int32), np.empty(len(e))
    for i in range(0, len(e), 8_192):
        s = e[i : i + 8_192] @ p.T
        which[i : i + 8_192] = s.argmax(1)
        sim[i : i + 8_192] = s.max(1)
    return pa.table({**{x: nodes.column(x) for x in ("graph_id", "node_id", "node_seq", "e")}, "pivot": pa.array(which), "angle": pa.array(np.arccos(np.clip(sim, -1, 1)))})


def vector_cells(held: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with cell, cells): nodes of large graphs dealt by their nearest pivot, a pivot being one node in CELL_NODES, and the angle to it.

    held: graph_id, node_id, node_seq, e; sizes: graph_id, cells. cells: graph_id, cell, pe (the pivot), inner and radius (the least
    and largest angle to it), block. A ring with far more nodes than a cell holds, as of a vector that many nodes share, is divided by identifier.

    A node meets all blocks of its graph, so these must not grow in number with it: there are BLOCKS at most, until
    one of them would take more than BLOCK_BYTES.
    """
    kinds = {f.name: f.dataType.simpleString() for f in held.schema}
    drawn = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.xxhash64("node_id"), "node_id"))
    pivots = held.join(sizes, "graph_id").withColumn("r", drawn).where(F.col("r") <= F.col("cells")).select(F.col("graph_id").alias("of"), (F.col("r") - 1).cast("int").alias("pivot"), F.col("e").alias("pe"))
    part = F.pmod(F.xxhash64("node_id"), F.lit(PARTS)).cast("int")
    sent = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    schema = f"graph_id {kinds['graph_id']}, node_id {kinds['node_id']}, node_seq long, e {kinds['e']}, pivot int, angle double"
    own = held.join(sizes.select("graph_id"), "graph_id", "left_semi").withColumn("p", part)
    near = kept(own.groupBy("graph_id", "p").cogroup(sent.groupBy("of", "part")).applyInArrow(_to_pivots, schema))
    near = near.withColumn("ring", F.col("pivot") * F.lit(RINGS + 1) + F.floor(F.col("angle") / F.lit(np.pi) * F.lit(RINGS)))
    found = near.groupBy("graph_id", "pivot", "ring").agg(F.min("angle").alias("inner"), F.max("angle").alias("radius"), F.count("*").alias("n"))
    found = found.withColumn("split", F.ceil(F.col("n") / F.lit(2 * CELL_NODES)).cast("int"))
    dealt = near.join(found.select("graph_id", "ring", "split"), ["graph_id", "ring"])
    most = F.lit(1 << 20)
    dealt = dealt.withColumn("cell", F.col("ring") * most + F.pmod(F.xxhash64("node_id", F.lit(1)), F.col("split")))
    cells = found.join(pivots.withColumnRenamed("of", "graph_id"), ["graph_id", "pivot"])
    cells = cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("split") - 1))).withColumn("cell", F.col("ring") * most + F.col("k")).withColumn("n", F.ceil(F.col("n") / F.col("split")))
    of = Window.partitionBy("graph_id")
    total, before = F.sum("n").over(of), F.sum("n").over(of.orderBy("cell")) - F.col("n")
    blocks = F.greatest(F.least(F.lit(BLOCKS), F.ceil(total / F.lit(CELL_NODES))), F.ceil(total * F.size("pe") * F.lit(8) / F.lit(BLOCK_BYTES)))
    cells = cells.withColumn("block", F.floor(before * blocks / total).cast("int"))
    return dealt.select("graph_id", "node_id", "node_seq", "e", "cell"), cells.select("graph_id", "cell", "pe", "inner", "radius", "block")


def cell_pairs(cells: DataFrame, cutoff: float) -> DataFrame:
    """(graph_id, c1, c2, b1, b2, near) of a graph's pairs of cells, c1 <= c2, and their blocks; near is false where no two of their nodes can be more similar than the cutoff.

    Angles between unit vectors obey the triangle inequality: nodes of two cells are at least the angle of the
    pivots less both radii apart, and no nearer than a cell's inner angle less the way to the other's far end. A negative cutoff, which zero vectors also meet, skips nothing.
    """
    a = cells.select("graph_id", F.col("cell").alias("c1"), direction(F.col("pe")).alias("p1"), F.col("inner").alias("i1"), F.col("radius").alias("r1"), F.col("block").alias("b1"))
    b = cells.select("graph_id", F.col("cell").alias("c2"), direction(F.col("pe")).alias("p2"), F.col("inner").alias("i2"), F.col("radius").alias("r2"), F.col("block").alias("b2"))
    both = a.join(b, "graph_id").where("c1 <= c2")
    between = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("p1"), F.col("p2")))))
    apart = F.greatest(between - F.col("r1") - F.col("r2"), F.col("i1") - between - F.col("r2"), F.col("i2") - between - F.col("r1"))
    near = apart <= float(np.arccos(min(cutoff, 1.0))) + 1e-6 if cutoff >= 0 else F.lit(True)
    return both.select("graph_id", "c1", "c2", "b1", "b2", (near | (F.col("c1") == F.col("c2"))).alias("near"))


def similarity_edges(nodes: DataFrame, existing: DataFrame, c: MemoryConfig = DEFAULT) -> DataFrame:
    """Each node's nearest neighbours in its graph; pairs above the cutoff that are not yet linked.

    A graph of up to CELL_NODES nodes is one task. The nodes of a larger one are dealt into cells around pivots, and these into a
    few blocks. A pair of blocks is a task that multiplies their vectors and keeps a few partners a node, so no list of pairs is made; pairs of cells
    that are too far apart are skipped by a bound, exactly. Each node is sent once for each block with a cell near its own: BLOCKS times at most,
    so what is shuffled grows as the nodes do, until a block is full (BLOCK_BYTES). The pairs that are compared grow with the square.
    The links of larger graphs are stored, as all that reads them would find them anew. Nodes without a vector have
    no neighbours; vectors of several lengths in a graph raise.
    """
    held = nodes.where("embedding IS NOT NULL").select("graph_id", "node_id", F.col("node_seq").cast("long").alias("node_seq"), F.col("embedding").alias("e"))
    sizes = held.groupBy("graph_id").agg(F.ceil(F.count("*") / F.lit(CELL_NODES)).cast("int").alias("cells")).where("cells > 1")
    alone = {"cell": F.lit(0).cast("long"), "c1": F.lit(0), "c2": F.lit(0), "second": F.lit(False)}
    large = not sizes.isEmpty()
    if not large:
        paired = held.withColumns(alone)
    else:
        sizes = kept(sizes)
        dealt, cells = vector_cells(held, sizes)
        end = lambda cell, second: F.struct(F.col(cell).alias("cell"), second.alias("second"))
        near = cell_pairs(kept(cells), c.min_similarity).where("near").withColumn("end", F.explode(F.array(end("c1", F.lit(False)), end("c2", F.col("b1") < F.col("b2")))))
        ends = kept(near.select("graph_id", "end.cell", F.col("b1").alias("c1"), F.col("b2").alias("c2"), "end.second").distinct())
        cols = ["graph_id", "node_id", "node_seq", "e", "cell", "c1", "c2", "second"]
        small = held.join(sizes, "graph_id", "left_anti").withColumns(alone)
        paired = dealt.join(ends, ["graph_id", "cell"]).select(*cols).unionByName(small.select(*cols))
    kinds = {f.name: f.dataType.simpleString() for f in held.schema}
    schema = f"graph_id {kinds['graph_id']}, src {kinds['node_id']}, dst {kinds['node_id']}, dseq long, sim double"
    s = paired.groupBy("graph_id", "c1", "c2").applyInArrow(_near(c.neighbours, c.min_similarity), schema)
    rank = F.row_number().over(Window.partitionBy("graph_id", "src").orderBy(F.rint(F.col("sim") * F.lit(DECIMALS)).desc(), F.col("dseq").desc()))
    near = s.withColumn("r", rank).where(F.col("r") <= c.neighbours)
    pair = near.groupBy("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg((F.max("sim") * F.lit(c.similarity_gain)).alias("weight"))
    return both_ways((kept(pair) if large else pair).join(existing, ["graph_id", "src", "dst"], "left_anti"))


def hubs(degrees: DataFrame, c: MemoryConfig = DEFAULT) -> DataFrame:
    d = degrees.where(F.col("degree") >= c.hub_degree).withColumn("hub_score", F.col("degree") * F.col("total_weight"))
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.round("hub_score", 9).desc(), "node_seq"))
    return d.withColumn("hub_rank", rank).where(F.col("hub_rank") <= c.max_clusters)


def greedy_clusters(hub_rows: DataFrame, edges: DataFrame, c: MemoryConfig = DEFAULT) -> DataFrame:
    """Hubs in order; a processed hub is skipped; a hub takes its nearest neighbours not yet processed.

    A fold over at most ``max_clusters`` hubs per graph, each with cluster_size - 1 neighbours.
    """
    w = Window.partitionBy("graph_id", "src").orderBy(F.round("weight", 12).desc(), "edge_seq")
    near = edges.withColumn("r", F.row_number().over(w)).where(F.col("r") < c.cluster_size)
    lists = near.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "dst"))), lambda x: x["dst"]).alias("near"))
    per = hub_rows.join(lists, ["graph_id", "node_id"]).groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("hub_rank", F.col("node_id").alias("hub"), "near"))).alias("hubs"))
    zero = F.expr("named_struct('done', CAST(array() AS ARRAY<BIGINT>), 'out', CAST(array() AS ARRAY<STRUCT<hub: BIGINT, members: ARRAY<BIGINT>>>))")

    def step(s, h):
        new = F.array_except(F.array_union(F.array(h["hub"]), h["near"]), s["done"])
        taken = F.struct(F.array_union(s["done"], new).alias("done"), F.concat(s["out"], F.array(F.struct(h["hub"].alias("hub"), new.alias("members")))).alias("out"))
        return F.when(F.array_contains(s["done"], h["hub"]), s).otherwise(taken)

    return per.select("graph_id", F.inline(F.aggregate("hubs", zero, step)["out"])).where(F.size("members") >= 2)


def forget_candidates(nodes: DataFrame, edges: DataFrame, as_of: Column, min_weight: float = 0.1, min_age: int = 30) -> DataFrame:
    """Nodes with little edge weight, no access and an age above min_age; unreadable dates count 999 days.

    Weights are compared to nine decimals, so that a sum of exactly ``min_weight`` stays whichever way its doubles add up.
    """
    d = degrees(nodes, edges).select("graph_id", "node_id", "total_weight")
    age = F.coalesce(F.floor((F.unix_timestamp(as_of) - F.unix_timestamp("ts")) / 86400), F.lit(999))
    return nodes.join(d, ["graph_id", "node_id"]).withColumn("age_days", age).where((F.round("total_weight", 9) < min_weight) & (F.col("access_count") == 0) & (F.col("age_days") > min_age))


def forget(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    g = gone.select("graph_id", "node_id")
    e = edges.join(g.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_anti").join(g.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_anti")
    return nodes.join(g, ["graph_id", "node_id"], "left_anti"), e


def forgetting_preview(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> DataFrame:
    """A row per candidate: its weight and age, the edges that would go with it, and the beginning of its text; nothing is removed.

    ``gone`` are rows of ``forget_candidates`` over nodes with a content.
    """
    ends = edges.select("graph_id", F.col("src").alias("node_id")).unionByName(edges.select("graph_id", F.col("dst").alias("node_id")))
    n = ends.groupBy("graph_id", "node_id").agg(F.count("*").alias("n_edges"))
    seen = gone.join(n, ["graph_id", "node_id"], "left")
    return seen.select("graph_id", "node_id", F.round("total_weight", 9).alias("total_weight"), F.col("age_days").cast("long").alias("age_days"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.left("content", F.lit(50)).alias("preview"))


def adaptive_forgetting(nodes: DataFrame, edges: DataFrame, as_of: Column, min_weight: float = 0.1, min_age: int = 30, dry_run: bool = True, enabled: bool = False):
    """(candidates, nodes, edges): candidates are found only where forgetting is enabled and removed only without ``dry_run``."""
    gone = forget_candidates(nodes, edges, as_of, min_weight, min_age)
    if not enabled:
        gone = gone.limit(0)
    return gone, *((nodes, edges) if dry_run or not enabled else forget(nodes, edges, gone))
