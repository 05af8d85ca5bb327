"""End-to-end jobs: from dialogue files to stored memories, and from questions to scored answers.

    python -m engram.jobs encode --style sessions --source items.json --memory memory --as-of "2024-02-01 00:00:00"
    python -m engram.jobs evaluate --style sessions --source items.json --memory memory --out results --as-of "2024-02-01 00:00:00"

Styles: ``sessions`` are items with session lists and one question each, judged by a model; ``speakers`` are
samples of two speakers with many questions, scored by token overlap. Text models and encoders are named
as module:function, a function that makes the hook.
"""

import argparse
import importlib
import json
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.config import LOCOMO, LONGMEMEVAL, MemoryConfig
from engram.functions.models import extractive_model, hashed_encoder, recalling_model
from engram.functions.text import category_name
from engram.operators import graph as G
from engram.operators import knowledge as K
from engram.operators import metrics as M
from engram.operators import select as S
from engram.plans import answer as A
from engram.plans import encode as E
from engram.plans.cache import ModelCache
from engram.plans.state import kept
from engram.sources import sinks
from engram.sources.segments import Segments, knowledge, memory_graph
from engram.sources.store import questions, read_items, read_samples

STYLES = {"sessions": LONGMEMEVAL, "speakers": LOCOMO}


def _source(spark: SparkSession, style: str, path: str, ids: list[str] | None, start: int, n: int | None) -> DataFrame:
    """The chosen samples with a graph_id: by identifier, of which unknown ones raise, or by position in the source: files by name, samples as they stand in a file."""
    rows = read_items(spark, path) if style == "sessions" else read_samples(spark, path)
    rows = rows.withColumn("graph_id", F.col("question_id" if style == "sessions" else "sample_id"))
    if ids:
        return S.chosen_or_raise(rows, spark.createDataFrame([(i,) for i in ids], "graph_id string"), "graph_id")
    if start or n is not None:
        at = rows.groupBy("graph_id").agg(F.min("source_at").alias("at")).orderBy("at").offset(start)
        return S.chosen(rows, at if n is None else at.limit(n), "graph_id")
    return rows


#: What a run of evaluation stores: answers and scores by question, and metrics by sample or question type.
RESULTS = {
    "results": "graph_id {key}",
    "samples": "graph_id {key}",
    "failed": "graph_id {key}, error STRING",
}


def results(spark: SparkSession, out: str) -> Segments:
    """The stored results under a path: tables ``results``, ``samples`` and ``failed``, as JSON lines. A run replaces what its own samples had, at one go."""
    return Segments(spark, out, RESULTS, form="json")


def encode(spark: SparkSession, style: str, source: str, memory: str, as_of: str, ids: list[str] | None = None, start: int = 0, n: int | None = None,
           skip_knowledge: bool = False, encoder=hashed_encoder, model=extractive_model, cache: str | None = None, version: str = "") -> DataFrame:
    """Stores the memories and the knowledge of every chosen sample in one commit; returns the summary, which is also written.

    Encoding a graph again replaces it. A graph without a turn is stored empty and counts as failed; the
    table encode_samples under ``memory`` has a row for each sample, with the error of those that failed.
    ``cache`` is a folder that keeps what the models of this ``version`` gave, and how far profiles are folded,
    so that a run that is repeated asks for nothing twice.
    """
    known = None if cache is None else ModelCache(spark, cache, version)
    progress = None if cache is None else Segments(spark, f"{cache}/folds-{sha256(version.encode()).hexdigest()[:16]}", E.PROGRESS)
    rows, now, c = _source(spark, style, source, ids, start, n), F.lit(as_of), STYLES[style]
    graphs = kept(rows.select("graph_id").distinct())
    turns = kept(E.item_turns(rows, now) if style == "sessions" else E.sample_turns(rows))
    nodes, edges = E.memory_graph(turns, encoder, cache=known)
    state = {"nodes": nodes, "edges": edges}
    if not skip_knowledge:
        ordered = turns.withColumn("order", F.struct("session_seq", "turn_seq"))
        found = kept(E.extract(E.batch_texts(ordered, "graph_id", "order", c), model, known))
        whole = style == "sessions"
        state["facts"], state["fact_edges"] = E.knowledge_graph(E.facts(found, "private", whole), ["batch", "line_no"], now, encoder, known)
        seq = E.knowledge_graph(E.facts(found, "assistant", whole), ["batch", "line_no"], now, encoder, known)[0]
        told = seq.select("graph_id", F.col("node_seq").alias("ak_seq"), F.col("content").alias("knowledge"), "ts", "embedding")
        state["assistant"] = K.add_assistant_knowledge(spark.createDataFrame([], told.schema), told)
        state["profiles"] = E.fold_extracted(found, model, progress=progress).withColumn("last_updated", now)
    Segments(spark, memory).commit(state, graphs=graphs)
    size = turns.groupBy("graph_id").agg(F.count("*").alias("n_nodes"), F.sum(F.length("user_text") + F.length("ai_text")).alias("n_chars"))
    samples = graphs.join(size, "graph_id", "left").withColumn("error", F.when(F.col("n_nodes").isNull(), "no turn")).fillna(0, ["n_nodes", "n_chars"])
    fine = F.col("error").isNull()
    samples, seen = sinks.observed(samples, n_graphs=F.count_if(fine), n_failed=F.count_if(~fine), n_nodes=F.sum("n_nodes"), n_chars=F.sum("n_chars"))
    Segments(spark, f"{memory}/encode_samples", {"samples": "graph_id {key}"}, form="json").commit({"samples": samples})
    totals = {name: total or 0 for name, total in seen.of.items()}
    return sinks.write_summary(spark, f"{memory}/encode_summary", totals, "n_graphs BIGINT, n_failed BIGINT, n_nodes BIGINT, n_chars BIGINT", {"style": style, **vars(c)})


def evaluate_speakers(spark: SparkSession, source: str, memory: str, out: str, as_of: str, ids: list[str] | None = None, start: int = 0, n: int | None = None,
                      most: int | None = None, c: MemoryConfig = LOCOMO, encoder=hashed_encoder, model=recalling_model) -> DataFrame:
    """Answers and scores the questions of every sample that is stored; others are rows of ``failed``.

    Stores results with running means by sample, metrics by sample and failed samples; writes the summary, whose
    metrics are gathered while the results are written, and returns it. What the answers have reinforced is stored last.
    """
    samples = _source(spark, "speakers", source, ids, start, n)
    store = Segments(spark, memory)
    nodes, edges = memory_graph(store)
    stored = nodes.select("graph_id").distinct()
    asked = questions(samples, most).withColumnRenamed("sample_id", "graph_id").withColumn("query_id", F.concat("graph_id", F.lit("#"), "qa_index"))
    asked = asked.join(stored, "graph_id", "left_semi").withColumn("asked_on", F.lit(None).cast("string"))
    names = _speakers(samples)
    answers, found, gains = A.answer_questions((nodes, edges), knowledge(store), asked.join(names, "graph_id", "left"), c.top_k, c.kb_top_k, c, encoder, model)
    texts = found.join(nodes.select("graph_id", "node_id", "content"), ["graph_id", "node_id"]).groupBy("query_id")
    texts = texts.agg(F.transform(F.array_sort(F.collect_list(F.struct("out_rank", "content"))), lambda x: x["content"]).alias("retrieved"))
    rows = answers.select("query_id", F.col("answer").alias("system_answer"), "error").join(asked.drop("asked_on"), "query_id").join(texts, "query_id", "left")
    rows = rows.withColumns({"prediction": F.col("system_answer"), "reference": F.col("answer"), "category_name": category_name(F.col("category"))})
    scored = M.token_scores(rows).drop("query_id")
    for m in ("f1", "bleu1"):
        scored = M.running(scored, "graph_id", "qa_index", m, f"running_{m}")
    scored, seen = sinks.observed(scored, **sinks.token_totals())
    book, chosen = results(spark, out), kept(samples.select("graph_id").distinct())
    missing = chosen.join(stored, "graph_id", "left_anti").withColumn("error", F.lit("not stored"))
    missing, lost = sinks.observed(missing, n_failed=F.count("*"))
    scored = kept(scored)
    per_sample, each = sinks.observed(M.summary(scored, "graph_id"), n_samples=F.count("*"))
    book.commit({"results": scored, "samples": per_sample, "failed": missing}, graphs=chosen)
    totals = {**sinks.token_summary(seen.of), "n_samples": each.of["n_samples"] or 0, "n_failed": lost.of["n_failed"] or 0, "as_of": as_of}
    kinds = f"{sinks.SCORES}, per_category ARRAY<STRUCT<category: STRING, {sinks.SCORES.replace(' BIGINT', ': BIGINT').replace(' DOUBLE', ': DOUBLE')}>>, n_samples BIGINT, n_failed BIGINT, as_of STRING"
    summary = sinks.write_summary(spark, f"{out}/summary", totals, kinds, vars(c))
    store.commit(add={"edges": G.both_ways(gains)})
    return summary


def _speakers(samples: DataFrame) -> DataFrame:
    """(graph_id, speakers): the names of the two speakers of each sample, the asking one first."""
    name = lambda x: F.expr(f"try_element_at(conversation, '{x}')")
    return samples.select("graph_id", F.array_compact(F.array(name("speaker_a"), name("speaker_b"))).alias("speakers"))


def evaluate_sessions(spark: SparkSession, source: str, memory: str, out: str, as_of: str, corrupted: list[str] | None = None, ids: list[str] | None = None, start: int = 0,
                      n: int | None = None, c: MemoryConfig = LONGMEMEVAL, encoder=hashed_encoder, model=recalling_model, extractor=extractive_model, judge=None) -> DataFrame:
    """Consolidates every item's memories, answers its question and has the answer judged.

    Items that are listed as corrupted, not stored or empty score 0 without a row of results. A failed
    answer drops the item from the score and is a row of ``failed`` with its error; a failed judgement counts as
    wrong. Stores results and failed items, writes accuracies (accuracy) and the summary, and returns the
    accuracies. New facts and what the questions have reinforced are stored in one commit, last.
    """
    items = _source(spark, "sessions", source, ids, start, n)
    store = Segments(spark, memory)
    (nodes, edges), known = memory_graph(store), knowledge(store)
    marked = spark.createDataFrame([(i, True) for i in corrupted or []], "graph_id string, bad boolean")
    held = store.graphs().withColumn("known", F.lit(True))
    filled = nodes.select("graph_id").distinct().withColumn("filled", F.lit(True))
    state = items.join(marked, "graph_id", "left").join(held, "graph_id", "left").join(filled, "graph_id", "left")
    state = kept(state.withColumn("status", S.status(F.col("bad").isNotNull(), F.col("known").isNull(), F.col("filled").isNull())).drop("bad", "known", "filled"))
    ready = state.where("status = 'evaluated'")
    nodes_now, edges_now = (df.join(ready.select("graph_id"), "graph_id", "left_semi") for df in (nodes, edges))
    facts = kept(E.consolidate(nodes_now, edges_now, extractor, c))
    own = tuple(known[k].join(ready.select("graph_id"), "graph_id", "left_semi") for k in ("nodes", "edges"))
    new = tuple(kept(df) for df in E.new_knowledge(own, facts, F.lit(as_of), encoder))
    known |= {k: a.unionByName(b, allowMissingColumns=True) for k, a, b in zip(("nodes", "edges"), own, new, strict=True)}
    asked = ready.select(F.col("graph_id").alias("query_id"), "graph_id", F.lit(0).alias("qa_index"), "question", F.col("question_date").alias("asked_on"))
    answers, _, gains = A.answer_questions((nodes_now, edges_now), known, asked, c.top_k, c.kb_top_k, c, encoder, model)
    rows = answers.select(F.col("query_id").alias("question_id"), "answer", "error").join(ready.select("graph_id", "question_id", "question_type", "question", F.col("answer").alias("reference")), "question_id")
    rows = kept(rows)
    judged, failed = kept(A.judgements(rows.where("error IS NULL"), judge or model)), rows.where("error IS NOT NULL").select("graph_id", "error")
    failed, lost = sinks.observed(failed, n_failed=F.count("*"))
    results(spark, out).commit({"results": judged, "failed": failed}, graphs=state.select("graph_id"))
    zero = state.where("status <> 'evaluated'").select("question_type", F.lit(0).alias("correct"))
    accuracy = kept(M.accuracy(judged.select("question_type", F.col("correct").cast("int").alias("correct")).unionByName(zero)))
    accuracy.orderBy("question_type").coalesce(1).write.mode("overwrite").json(f"{out}/accuracy")
    counts = {r[0]: r[1] for r in state.groupBy("status").count().collect()}  # four states
    totals = {"items": counts, "n_failed": lost.of["n_failed"] or 0, "as_of": as_of}
    sinks.write_summary(spark, f"{out}/summary", totals, "items MAP<STRING, BIGINT>, n_failed BIGINT, as_of STRING", vars(c))
    store.commit(add={"facts": new[0], "fact_edges": new[1], "edges": G.both_ways(gains)})
    return accuracy


def _hook(name: str | None, default):
    if not name:
        return default
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Encode dialogues into memories; answer and score questions over them.")
    parser.add_argument("job", choices=["encode", "evaluate"])
    parser.add_argument("--style", choices=list(STYLES), required=True)
    for name in ("source", "memory", "as-of"):
        parser.add_argument(f"--{name}", required=True)
    for name in ("out", "encoder", "model", "extractor", "judge", "cache", "version"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--ids", nargs="*")
    parser.add_argument("--corrupted", nargs="*")
    parser.add_argument("--start", type=int, default=0)
    for name in ("n", "max-questions", "top-k", "knowledge-top-k"):
        parser.add_argument(f"--{name}", type=int)
    parser.add_argument("--skip-knowledge", action="store_true")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName(f"engram {a.job}").getOrCreate()
    given = {k: v for k, v in (("top_k", a.top_k), ("kb_top_k", a.knowledge_top_k)) if v is not None}
    c = MemoryConfig(**{**vars(STYLES[a.style]), **given})
    extractor = _hook(a.extractor or a.model, extractive_model)
    hooks = {"encoder": _hook(a.encoder, hashed_encoder), "model": _hook(a.model, recalling_model)}
    if a.job == "encode":
        out = encode(spark, a.style, a.source, a.memory, a.as_of, a.ids, a.start, a.n, a.skip_knowledge, hooks["encoder"], extractor, a.cache, a.version or f"{a.encoder} {a.extractor or a.model}")
    elif not a.out:
        parser.error("evaluate needs --out")
    elif a.style == "speakers":
        out = evaluate_speakers(spark, a.source, a.memory, a.out, a.as_of, a.ids, a.start, a.n, a.max_questions, c, **hooks)
    else:
        out = evaluate_sessions(spark, a.source, a.memory, a.out, a.as_of, a.corrupted, a.ids, a.start, a.n, c, extractor=extractor, judge=_hook(a.judge, None), **hooks)
    for row in out.toJSON().collect():  # a summary, or a row per question type
        print(json.dumps(json.loads(row), ensure_ascii=False, indent=2))


if __name__ == "__main__":
    main()
