"""Tables by graph as immutable segments that a manifest makes visible.

A commit writes the rows of any number of tables, then publishes one manifest; a writer that dies
before that leaves the old state, and of two writers of one version the second fails. A segment
either replaces what its graphs had or adds to it, so reinforced edges are stored as increments
and summed when they are read. Segments are folders hashed by graph, and the identifier is a
column of its own type. ``compact`` folds all segments into one a table.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "graph_id {key}, node_seq LONG, node_id LONG, content STRING, role STRING, ts STRING, keywords ARRAY<STRING>, embedding ARRAY<FLOAT>"
EDGES = "graph_id {key}, src LONG, dst LONG, weight DOUBLE"
#: The tables of a memory: the dialogue's graph, and what is known: profiles, the assistant's traits, facts as a graph, fallback rows that are read only.
MEMORY = {
    "nodes": NODES,
    "edges": EDGES,
    "profiles": "graph_id {key}, data STRING, last_updated STRING",
    "assistant": "graph_id {key}, ak_seq LONG, knowledge STRING, ts STRING, embedding ARRAY<FLOAT>",
    "facts": NODES,
    "fact_edges": EDGES,
    "fallback": "graph_id {key}, node_seq LONG, node_id LONG, content STRING, ts STRING, embedding ARRAY<FLOAT>",
}
#: Tables whose added rows are increments of a weight that stops at 1.
WEIGHTED = {"edges", "fact_edges"}


class ConflictingCommit(RuntimeError):
    """Another writer has published the version that this one was about to."""


class Segments:
    """Tables under a path. ``tables`` gives the columns of tables that nothing is stored of; ``key`` is the type of graph_id."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str] = MEMORY, key: str = "string", buckets: int = 16, form: str = "parquet"):
        jvm = spark._jvm
        self.spark, self.tables, self._fs = spark, tables, jvm.org.apache.hadoop.fs
        at = self._fs.Path(path)
        conf = spark._jsc.hadoopConfiguration()
        self._files = at.getFileSystem(conf)
        self.path = self._files.makeQualified(at).toString().rstrip("/")
        self._context = self._fs.FileContext.getFileContext(self._files.getUri(), conf)
        self._new = {"version": 0, "key": key, "buckets": buckets, "form": form, "batches": {}, "segments": [], "replaced": []}

    # --- manifests ------------------------------------------------------------

    def manifest(self) -> dict:
        """The last published one."""
        top = self._fs.Path(f"{self.path}/_commits")
        names = [f.getPath().getName() for f in self._files.listStatus(top)] if self._files.exists(top) else []
        last = max((n for n in names if n.endswith(".json")), default=None)
        if last is None:
            return json.loads(json.dumps(self._new))
        stream = self._files.open(self._fs.Path(f"{self.path}/_commits/{last}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, m: dict) -> int:
        """Makes the manifest visible at one go, unless its version is there already."""
        draft = self._fs.Path(f"{self.path}/_commits/draft-{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        try:
            out.write(bytearray(json.dumps(m).encode()))
        finally:
            out.close()
        plain = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0)
        try:
            self._context.rename(draft, self._fs.Path(f"{self.path}/_commits/{m['version']:020d}.json"), plain)
        except Exception as e:
            self._files.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise ConflictingCommit(f"version {m['version']} of {self.path} is there already") from None
            raise
        return m["version"]

    # --- writing --------------------------------------------------------------

    def _bucket(self, m: dict) -> Column:
        return F.pmod(F.xxhash64("graph_id"), F.lit(m["buckets"])).cast("int")

    def _write(self, df: DataFrame, m: dict, path: str) -> str:
        """Rows in folders by bucket; a large graph's rows come from several tasks. Returns the columns."""
        df = df.withColumn("graph_id", F.col("graph_id").cast(m["key"]))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        spread = F.pmod(F.xxhash64(*[F.col(f.name) for f in df.schema if "map" not in f.dataType.simpleString()]), F.lit(8))
        df.withColumn("_bucket", self._bucket(m)).repartition("_bucket", spread).write.partitionBy("_bucket").format(m["form"]).save(path)
        return kinds

    def commit(self, replace: dict[str, DataFrame] | None = None, add: dict[str, DataFrame] | None = None, graphs: DataFrame | None = None, batch: tuple[str, int] | None = None) -> int:
        """One new version. ``replace``: rows in the place of what their graphs had in these tables. ``graphs`` lists these graphs, also those
        of which nothing is left; without a list they are those that occur in the frames, which are then read twice.
        ``add``: rows that come on top, in weighted tables increments.

        ``batch`` names a writer and its running number; a number that is stored already does nothing, so that a
        batch that is written again counts once. Returns the version.
        """
        m, replace, add = self.manifest(), replace or {}, add or {}
        if batch and m["batches"].get(batch[0], -1) >= batch[1]:
            return m["version"]
        m["version"] += 1
        folder = f"data/{m['version']:08d}-{uuid.uuid4().hex}"
        if replace:
            frames = [df.select(F.col("graph_id").cast(m["key"]).alias("graph_id")) for df in (replace.values() if graphs is None else [graphs])]
            ids = frames[0]
            for df in frames[1:]:
                ids = ids.unionByName(df)
            ids.distinct().write.parquet(f"{self.path}/{folder}/graphs")
            m["replaced"].append({"version": m["version"], "path": f"{folder}/graphs", "tables": sorted(replace)})
        for kind, frames in (("replace", replace), ("add", add)):
            for table, df in frames.items():
                columns = self._write(df, m, f"{self.path}/{folder}/{kind}/{table}")
                m["segments"].append({"version": m["version"], "table": table, "kind": kind, "path": f"{folder}/{kind}/{table}", "columns": columns})
        if batch:
            m["batches"][batch[0]] = batch[1]
        return self._publish(m)

    def compact(self) -> int:
        """All segments folded into one a table; graphs without rows stay known."""
        m = self.manifest()
        known, read = self.graphs(), {t: self.read(t) for t in sorted({s["table"] for s in m["segments"]})}
        m["version"] += 1
        folder = f"data/{m['version']:08d}-{uuid.uuid4().hex}"
        known.write.parquet(f"{self.path}/{folder}/graphs")
        m["replaced"] = [{"version": m["version"], "path": f"{folder}/graphs", "tables": sorted(read)}]
        m["segments"] = [{"version": m["version"], "table": t, "kind": "replace", "path": f"{folder}/replace/{t}", "columns": self._write(df, m, f"{self.path}/{folder}/replace/{t}")} for t, df in read.items()]
        return self._publish(m)

    def vacuum(self, hours: float = 24.0) -> list[str]:
        """Deletes data folders that the last manifest doesn't name and that are older than ``hours``: compacted ones, and those of writers that died. Returns their names."""
        m = self.manifest()
        named = {x["path"].split("/")[1] for k in ("segments", "replaced") for x in m[k]}
        top, gone = self._fs.Path(f"{self.path}/data"), []
        for f in self._files.listStatus(top) if m["version"] else []:
            if f.getPath().getName() not in named and f.getModificationTime() < (time.time() - hours * 3600) * 1000:
                self._files.delete(f.getPath(), True)
                gone.append(f.getPath().getName())
        return gone

    # --- reading --------------------------------------------------------------

    def read(self, table: str, graphs: list | None = None) -> DataFrame:
        """The table's rows as of the last manifest. With a short list of graphs only the folders that can hold them are read."""
        m = self.manifest()
        parts = [s for s in m["segments"] if s["table"] == table]
        if not parts:
            return self.spark.createDataFrame([], self.tables[table].format(key=m["key"]))
        rows = None
        for s in parts:
            df = self.spark.read.schema(f"{s['columns']}, _bucket INT").format(m["form"]).load(f"{self.path}/{s['path']}").withColumn("_version", F.lit(s["version"]))
            rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
        if graphs is not None:
            wanted = self.spark.createDataFrame([(g,) for g in graphs], f"graph_id {m['key']}").select("graph_id", self._bucket(m).alias("b")).collect()
            rows = rows.where(F.col("_bucket").isin([r.b for r in wanted]) & F.col("graph_id").isin([r.graph_id for r in wanted]))
        first = min(s["version"] for s in parts)
        marks = [r for r in m["replaced"] if table in r["tables"] and r["version"] > first]
        if marks:
            last = self._marks(marks, m).groupBy("graph_id").agg(F.max("_from").alias("_from"))
            rows = rows.join(last, "graph_id", "left").where(F.col("_version") >= F.coalesce("_from", F.lit(0))).drop("_from")
        rows = rows.drop("_version", "_bucket")
        if table in WEIGHTED and any(s["kind"] == "add" for s in parts):
            rows = rows.groupBy("graph_id", "src", "dst").agg(F.least(F.lit(1.0), F.sum("weight")).alias("weight"))
        return rows

    def _marks(self, marks: list[dict], m: dict) -> DataFrame:
        out = None
        for r in marks:
            df = self.spark.read.schema(f"graph_id {m['key']}").parquet(f"{self.path}/{r['path']}").withColumn("_from", F.lit(r["version"]))
            out = df if out is None else out.unionByName(df)
        return out

    def graphs(self) -> DataFrame:
        """The graph_id of all stored graphs, empty ones too."""
        m = self.manifest()
        out = self.spark.createDataFrame([], f"graph_id {m['key']}")
        if m["replaced"]:
            out = out.unionByName(self._marks(m["replaced"], m).select("graph_id"))
        for s in m["segments"]:
            if s["kind"] == "add":
                out = out.unionByName(self.spark.read.schema(f"{s['columns']}, _bucket INT").format(m["form"]).load(f"{self.path}/{s['path']}").select("graph_id"))
        return out.distinct()


def memory_graph(store: Segments) -> tuple[DataFrame, DataFrame]:
    return store.read("nodes"), store.read("edges")


def knowledge(store: Segments) -> dict[str, DataFrame]:
    """profiles, assistant, nodes, edges and fallback; fallback rows serve graphs without nodes only."""
    return {"profiles": store.read("profiles"), "assistant": store.read("assistant"), "nodes": store.read("facts"), "edges": store.read("fact_edges"), "fallback": store.read("fallback")}
