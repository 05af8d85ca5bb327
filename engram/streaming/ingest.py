"""Turns as a stream: utterances become memory nodes, edges, full buffers and what is extracted from them, in a stored memory."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from engram.config import DEFAULT, MemoryConfig
from engram.functions.models import Encoder, embedding, extractive_model, hashed_encoder
from engram.operators import graph as G
from engram.operators import knowledge as K
from engram.plans import encode as E
from engram.plans.state import kept
from engram.sources.segments import Segments, knowledge

TURNS = "graph_id {key}, kind string, node_seq long, prev_seq long, ts string, batch long, content string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Turns(StatefulProcessor):
    """Per graph: the next identifier, the utterances without a reply, and the turns of the buffer that isn't full."""

    def __init__(self, buffer_turns: int, idle_seconds: float | None):
        self.size, self.idle = buffer_turns, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "seq long, batch long")
        self.waiting = handle.getListState("waiting", "text string, ts string")
        self.buffer = handle.getListState("buffer", "content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, batch = self.counts.get() or (0, 0)
        waiting, buffer, out = list(self.waiting.get()), [r[0] for r in self.buffer.get()], []
        for r in pd.concat(list(rows)).sort_values("pos", kind="stable").itertuples():
            if not r.text:
                continue
            if r.is_user:
                waiting.append((r.text, r.ts))
            elif waiting:
                text, ts = waiting.pop(0)
                content = f"User: {text}\nAI: {r.text}"
                out.append((key[0], "turn", seq, seq - 1 if seq else None, ts, batch, content))
                seq, buffer = seq + 1, [*buffer, content]
                if len(buffer) == self.size:
                    out.append((key[0], "buffer", None, None, ts, batch, "\n".join(buffer)))
                    batch, buffer = batch + 1, []
        self.counts.update((seq, batch))
        for state, left in ((self.waiting, waiting), (self.buffer, [(b,) for b in buffer])):
            state.put(left) if left else state.clear()
        if self.idle is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if buffer:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.idle * 1000))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        buffer = [r[0] for r in self.buffer.get()]
        if buffer:
            seq, batch = self.counts.get()
            self.counts.update((seq, batch + 1))
            self.buffer.clear()
            yield self._frame([(key[0], "buffer", None, None, None, batch, "\n".join(buffer))])

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["graph_id", "kind", "node_seq", "prev_seq", "ts", "batch", "content"])
        return out.astype({"node_seq": "Int64", "prev_seq": "Int64", "batch": "int64"})

    def close(self) -> None:
        pass


def ingest(rows: DataFrame, buffer_turns: int = DEFAULT.buffer_turns, idle_seconds: float | None = None) -> DataFrame:
    """Turns and full buffers of a stream (graph_id, pos, is_user, text, ts): a reply takes the oldest waiting utterance, without one it is dropped.

    Rows of kind ``turn`` are nodes (node_seq, prev_seq, ts, content), those of kind ``buffer`` the joined
    texts of ``buffer_turns`` turns. Within a micro-batch rows go by pos; a row that comes in a later batch counts as
    later. A buffer that isn't filled is given out once its graph was idle for ``idle_seconds``, if that is
    set. Rows with empty or null text are skipped. The session's state store becomes RocksDB, which this needs.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    kind = rows.schema["graph_id"].dataType.simpleString()
    rows = rows.select("graph_id", "pos", "is_user", "text", F.col("ts").cast("string").alias("ts") if "ts" in rows.columns else F.lit(None).cast("string").alias("ts"))
    return rows.groupBy("graph_id").transformWithStateInPandas(Turns(buffer_turns, idle_seconds), TURNS.format(key=kind), "append", "processingTime" if idle_seconds is not None else "none")


def stored_batch(store: Segments, name: str, c: MemoryConfig = DEFAULT, encoder: Callable[[], Encoder] = hashed_encoder, model=extractive_model, keyword_model=None, skip_knowledge: bool = False):
    """A function for foreachBatch that stores a micro-batch of ``ingest`` in one commit: nodes with vectors and keywords, edges, and what is extracted from full buffers.

    The commit bears the batch's number, so a batch that is run again after a failure counts once.
    """

    def save(rows: DataFrame, number: int) -> None:
        if store.manifest()["batches"].get(name, -1) >= number:
            return
        rows = kept(rows)
        turns, full = rows.where("kind = 'turn'"), rows.where("kind = 'buffer'")
        nodes = turns.select("graph_id", "node_seq", F.col("node_seq").alias("node_id"), "content", F.lit("interaction").alias("role"), "ts")
        nodes = K.with_model_keywords(nodes, "content", keyword_model) if keyword_model else K.with_keywords(nodes, "content")
        nodes = nodes.withColumn("embedding", embedding(F.col("content"), encoder))
        chain = turns.where("prev_seq IS NOT NULL").select("graph_id", F.col("prev_seq").alias("src"), F.col("node_seq").alias("dst"), F.lit(0.5).alias("weight"))
        add, replace, graphs = {"nodes": nodes, "edges": G.both_ways(chain)}, {}, None
        if not skip_knowledge and not full.isEmpty():
            graphs = full.select("graph_id").distinct()
            held = {k: df.join(graphs, "graph_id", "left_semi") for k, df in knowledge(store).items()}
            found, now = kept(E.extract(full.select("graph_id", "batch", F.col("content").alias("text")), model)), F.lit(None).cast("string")
            facts = E.facts(found, "private").select("graph_id", F.col("batch").alias("hub"), "line_no", "content")
            add["facts"], add["fact_edges"] = E.new_knowledge((held["nodes"], held["edges"]), facts, now, encoder)
            told = E.knowledge_graph(E.facts(found, "assistant"), ["batch", "line_no"], now, encoder)[0]
            told = told.select("graph_id", F.col("node_seq").alias("ak_seq"), F.col("content").alias("knowledge"), "ts", "embedding")
            replace["assistant"] = K.add_assistant_knowledge(held["assistant"].select(*told.columns), told)
            replace["profiles"] = E.fold_extracted(found, model, held["profiles"]).withColumn("last_updated", now)
        store.commit(replace, add, graphs, batch=(name, number))

    return save


def stream_into(store: Segments, rows: DataFrame, name: str, checkpoint: str, c: MemoryConfig = DEFAULT, idle_seconds: float | None = None, trigger: dict | None = None, **hooks) -> StreamingQuery:
    """Starts the stream of turns into the stored memory; ``name`` and ``checkpoint`` belong together."""
    out = ingest(rows, c.buffer_turns, idle_seconds).writeStream.foreachBatch(stored_batch(store, name, c, **hooks))
    return out.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
