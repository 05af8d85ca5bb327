import hashlib
import json
import math
import random
import re
import time
import uuid
from collections import Counter

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engram import catalog, jobs
from engram.config import replace
from engram.functions import models, prompts
from engram.functions import text as T
from engram.operators import graph as G
from engram.operators import knowledge as K
from engram.operators import metrics as M
from engram.operators import retrieve as R
from engram.plans import answer, encode
from engram.plans import rounds as folds
from engram.plans.cache import ModelCache
from engram.sources import store
from engram.sources.documents import array_elements
from engram.sources.segments import ConflictingCommit, Segments, knowledge, memory_graph
from engram.streaming.ingest import ingest, stored_batch, stream_into

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("text, want", [("- short", None), ("- a fact - with a dash", "a fact - with a dash"), ("none", None), ("no dash in this line", "no dash in this line")])
def test_fact_line(spark, text, want):
    assert spark.createDataFrame([(text,)], "v string").select(T.fact_line(F.col("v"))).first()[0] == want


def test_strip_of_all_white_space(spark):
    """As the pattern has it, and in linear time: a long run of spaces inside a line is walked once."""
    odd = [chr(c) for c in (*range(1, 0x21), 0x85, 0xA0, 0x1680, *range(0x1FFF, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
    texts = [None, "", " ", "a", *[x + "-" + x + "b" + x + x for x in odd], "".join(odd) + "é" + "".join(odd[::-1]), " a\n", "a \r\n\x85"]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select("v", T.strip(F.col("v")).alias("got"), F.regexp_replace("v", f"^{T.SPACE}+|{T.SPACE}+$", "").alias("want")).collect()
    assert len(rows) == len(texts) and [r.v for r in rows if r.got != r.want] == []
    began = time.time()
    assert spark.createDataFrame([("a" + " " * 400_000 + "b",)], "v string").select(F.length(T.clean_line(F.col("v")))).first()[0] == 400_002
    assert time.time() - began < 20


def test_models_take_a_batch_in_pieces(spark):
    """An encoder never gets a whole batch of Arrow, and the vectors and replies of all pieces are those of their rows."""
    n = 3 * models.PIECE + 1

    def make():
        encode = models.hashed_encoder(8)
        return lambda texts: encode(texts) if len(texts) <= models.PIECE else 1 / 0

    rows = spark.range(0, n, 1, 1).withColumn("t", F.when(F.col("id") % 5 > 0, F.concat(F.lit("word"), "id")))
    got = rows.select("id", "t", models.embedding(F.col("t"), make).alias("v"), models.replies(F.col("t"), lambda: lambda p: p.upper()).alias("r")).collect()
    assert len(got) == n
    for r in got:
        assert r.v == models.hashed_encoder(8)([r.t or ""])[0].tolist()
        assert tuple(r.r) == (("", "no prompt") if r.t is None else (r.t.upper(), None))


def test_items(spark, tmp_path):
    item = {"question_id": "q1", "haystack_dates": ["d1"], "haystack_sessions": [[{"role": r, "content": f"{r}{i}"} for i, r in enumerate(["assistant", "user", "user", "assistant"])], [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]]}
    (tmp_path / "items.json").write_text(json.dumps([item]))
    rows = encode.item_turns(store.read_items(spark, str(tmp_path / "items.json"))).collect()
    assert sorted((r.session_seq, r.ts, r.user_text, r.ai_text) for r in rows) == [(0, "d1", "user2", "assistant3"), (1, None, "u", "a")]


@pytest.mark.parametrize("wrapped", [False, True])
def test_samples(spark, tmp_path, wrapped):
    talk = [{"speaker": s, "text": t} for s, t in [("A", "one"), ("A", ""), ("A", "two"), ("B", "r1"), ("B", "r2"), ("B", "r3")]] + [{"speaker": "A", "text": "", "blip_caption": "cat"}, {"speaker": "B", "text": "r4"}]
    sample = {"sample_id": "s", "conversation": {"speaker_a": "A", "speaker_b": "B", "session_1": talk, "session_1_date_time": "noon"}, "qa": []}
    (tmp_path / "s.json").write_text(json.dumps({"samples": [sample]} if wrapped else [sample]))
    rows = encode.sample_turns(store.read_samples(spark, str(tmp_path / "s.json"))).orderBy("turn_seq").collect()
    assert [(r.user_text, r.ai_text, r.ts) for r in rows] == [("one", "r1", "noon"), ("two", "r2", "noon"), ("[image: cat]", "r4", "noon")]


def test_graph_and_store(spark, tmp_path):
    turns = spark.createDataFrame([(g, 1, i, None, f"u{i}", f"a{i}") for g in ("x", "y") for i in range(3)], "graph_id string, session_seq int, turn_seq int, ts string, user_text string, ai_text string")
    n, e = encode.memory_graph(turns)
    store = Segments(spark, str(tmp_path))
    store.commit({"nodes": n, "edges": e})
    store.commit({"nodes": n.where("graph_id = 'x' AND node_seq < 2"), "edges": e.where("graph_id = 'x' AND src < 2 AND dst < 2")})
    nodes, edges = memory_graph(store)
    assert {tuple(r) for r in nodes.groupBy("graph_id").count().collect()} == {("x", 2), ("y", 3)}
    assert edges.where("graph_id = 'y'").count() == 4
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in n.collect())


def test_completion_failures(spark):
    def make():
        def reply(prompt):
            if "bad" in prompt:
                raise ValueError
            return prompt.upper()

        return reply

    df = spark.createDataFrame([("ok",), ("bad",), (None,)], "v string")
    assert [r[0] for r in df.select(models.completion(F.col("v"), make)).collect()] == ["OK", "", ""]


def test_extract_markers(spark):
    def make():
        return lambda p: {"1": "profile\n[PRIVATE]\n- likes tea\n- None", "2": "profile only", "3": "a [PRIVATE] b [PRIVATE] c"}[p.rsplit("\n", 1)[-1]]

    got = encode.extract(spark.createDataFrame([(1, i, str(i)) for i in (1, 2, 3)], "graph_id long, batch long, text string"), make)
    assert {r.batch: (r.profile, r.private) for r in got.collect()} == {1: ("profile", "- likes tea\n- None"), 2: ("profile only", "None")}
    assert [r.content for r in encode.facts(got, "private").collect()] == ["likes tea"]


def test_profiles(spark):
    rows = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", True), (2, 1, "c", True), (3, 1, "d", True), (3, 2, "e", False)], "k int, i int, d string, m boolean")
    got = {r.k: r.data for r in K.fold_profiles(rows, "k", [F.col("i")], "d", F.col("m")).collect()}
    assert got == {1: "a\n\n--- Updated ---\nb", 2: "c", 3: "e"}


def test_consolidate_needs_three_nodes(spark):
    n = catalog.vec_nodes(spark, SF).withColumn("content", F.lit("a passage that is long enough")).where("graph_id = 0 AND node_seq <= 2 OR graph_id = 1")
    got = encode.consolidate(n, G.temporal_edges(n), c=catalog.LINKED)
    assert {r.graph_id for r in got.collect()} == {1}


def test_judgements(spark):
    rows = spark.createDataFrame([("q1", "multi-session", "q", "r", "yes"), ("q_abs", "multi-session", "q", "r", "no")], "question_id string, question_type string, question string, reference string, answer string")
    seen = answer.judgements(rows, lambda: lambda p: "Yes." if p.startswith(prompts.ABSTAIN) else "no").collect()
    assert {r.question_id: r.correct for r in seen} == {"q1": False, "q_abs": True}


def test_prompt_sections(spark):
    q = spark.createDataFrame([(1, 1, "why?", None), (2, 2, "who?", "today")], "query_id long, graph_id long, question string, asked_on string")
    res = spark.createDataFrame([(1, 1, 5, 1, 0.5, 0.7, False), (1, 1, 6, 2, 0.4, 0.3, True)], "query_id long, graph_id long, node_id long, out_rank long, score double, base_score double, flipped boolean")
    contents = spark.createDataFrame([(1, 5, "five", "noon"), (1, 6, "six", None)], "graph_id long, node_id long, content string, ts string")
    none = spark.createDataFrame([], "graph_id long, query_id long, out_rank long, seq long, content string, data string")
    got = {r.query_id: r.prompt for r in answer.answer_prompts(q, res, contents, none, none, none).collect()}
    assert "[Direct, relevance 0.50]\nTime: noon\nContent: five\n\n[Associative, relevance 0.40]\nContent: six" in got[1] and "Today" not in got[1]
    assert got[2] == f"{answer.INSTRUCTION}\n\nToday: today\n\nQuestion: who?"
    short = answer.answer_prompts(q, res, contents, none, none, none, replace(catalog.DEFAULT, flipped_in_context=False))
    assert "six" not in {r.query_id: r.prompt for r in short.collect()}[1]


def sequential_reference(rows, k, rate=0.01, alpha=0.1, gate=0.4, most=5):
    """One graph, plain loops: rows are (node, vector) in order, the first three are the queries."""
    w = {}
    for (a, _), (b, _) in zip(rows, rows[1:], strict=False):
        w[a, b] = w[b, a] = 0.5
    out = []
    for i in range(3):
        enh = {n: (sum(x * y for x, y in zip(v, rows[i][1], strict=True)) + 1) / 2 for n, v in rows}
        fin = dict(enh)
        for (a, b), x in w.items():
            if enh[a] > gate:
                fin[b] += enh[a] * x * alpha
        seq = {n: j for j, (n, _) in enumerate(rows)}
        order = lambda s: sorted(s, key=lambda n: (-round(s[n], 12), -seq[n]))[:k]
        base = order(enh)
        ids = base + [n for n in order(fin) if n not in base][:most]
        out += [(i + 1, n, r + 1, round(fin[n], 6)) for r, n in enumerate(ids)]
        for x, a in enumerate(ids):
            for b in ids[x + 1 :]:
                w[a, b] = w[b, a] = min(1.0, w.get((a, b), 0.0) + rate)
    return out


def test_sequential(spark):
    graphs = {}
    for r in sorted(catalog.vec_nodes(spark, SF).collect(), key=lambda r: r.node_seq):
        graphs.setdefault(r.graph_id, []).append((r.node_id, [float(x) for x in r.embedding]))
    want = sorted((g, *row) for g, rows in graphs.items() for row in sequential_reference(rows, 10))
    got = catalog.QUERIES["retrieve_sequential"](spark, SF).collect()
    assert sorted((r.graph_id, r.qa_index, r.node_id, r.out_rank, round(r.score, 6)) for r in got) == want


def test_sequential_queries_grow(spark):
    sf = "/root/testdata/sf0.1"
    want = {(r.graph_id, r.node_seq, r.node_id) for r in catalog.vec_nodes(spark, sf).collect() if r.node_seq <= 3 or r.node_seq % 100 == 0}
    got = catalog.QUERIES["retrieve_sequential"](spark, sf).select("graph_id", "qa_index", "query_id").distinct().collect()
    assert {tuple(r) for r in got} == want and max(i for _, i, _ in want) > 3


STREAM = "graph_id string, pos long, is_user boolean, text string, ts string"


def test_ingest(spark, tmp_path):
    first = [("1", 1, True, "u1", "t"), ("1", 2, True, "u2", "t2"), ("1", 3, False, "a1", "x"), ("2", 1, False, "early", "x"), ("2", 2, True, "", "x")]
    second = [("1", 4, False, "a2", "x"), ("1", 5, False, "late", "x"), ("2", 3, True, "v1", "t3"), ("2", 4, False, "b1", "x")]
    store = Segments(spark, f"{tmp_path}/store")
    start = lambda: stream_into(store, spark.readStream.schema(STREAM).parquet(f"{tmp_path}/in"), "talk", f"{tmp_path}/ck", replace(catalog.DEFAULT, buffer_turns=2)).awaitTermination()
    for rows in (first, second):  # the second run goes on from the checkpoint
        spark.createDataFrame(rows, STREAM).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        start()
    version = store.manifest()["version"]
    start()  # nothing new
    nodes, edges = memory_graph(store)
    assert [(r.graph_id, r.node_seq, r.ts, r.content) for r in nodes.orderBy("graph_id", "node_seq").collect()] == [("1", 0, "t", "User: u1\nAI: a1"), ("1", 1, "t2", "User: u2\nAI: a2"), ("2", 0, "t3", "User: v1\nAI: b1")]
    turns = spark.createDataFrame([("1", 0, 0, "t", "u1", "a1"), ("1", 0, 1, "t2", "u2", "a2"), ("2", 0, 0, "t3", "v1", "b1")], "graph_id string, session_seq int, turn_seq int, ts string, user_text string, ai_text string")
    want, links = encode.memory_graph(turns)  # the same as of a batch
    cols = ["graph_id", "node_seq", "node_id", "content", "role", "ts", "keywords", "embedding"]
    assert sorted(map(str, nodes.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, links.collect()))
    assert store.read("profiles").count() == 1 and {r.graph_id for r in store.read("assistant").collect()} == {"1"}  # one full buffer
    assert version == store.manifest()["version"]
    save = stored_batch(store, "talk")
    save(spark.createDataFrame([("1", "turn", 9, 8, "t", 0, "again")], "graph_id string, kind string, node_seq long, prev_seq long, ts string, batch long, content string"), 0)
    assert store.read("nodes").count() == 3  # a batch that is run again


def test_idle_buffers(spark, tmp_path):
    """A buffer that is never filled comes out when its graph has been idle."""
    spark.createDataFrame([("g", 1, True, "u1", "t"), ("g", 2, False, "a1", "t")], STREAM).coalesce(1).write.parquet(f"{tmp_path}/in")
    rows = ingest(spark.readStream.schema(STREAM).parquet(f"{tmp_path}/in"), 10, idle_seconds=1.0)
    q = rows.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="1 second").start(f"{tmp_path}/out")
    try:
        for _ in range(60):
            q.awaitTermination(1)
            got = spark.read.parquet(f"{tmp_path}/out").collect() if q.lastProgress else []
            if len(got) == 2:
                break
    finally:
        q.stop()
    assert sorted((r.kind, r.batch, r.content) for r in got) == [("buffer", 0, "User: u1\nAI: a1"), ("turn", 0, "User: u1\nAI: a1")]


TALK = [{"speaker": "A", "text": "I moved to Lyon in May and I like the river very much"}, {"speaker": "B", "text": "Lyon is lovely, I grew up close to the river there"}]


def sample(i, n_turns=4):
    body = [{**t, "text": f"{t['text']} {i} {k}"} for k in range(n_turns) for t in TALK]
    qa = [{"question": "Where did A move?", "answer": "Lyon", "category": 1, "evidence": []}, {"question": "Who likes the river?", "adversarial_answer": "A likes the river", "category": "5", "evidence": ["D1"]}]
    return {"sample_id": f"s{i}", "conversation": {"speaker_a": "A", "speaker_b": "B", "session_1": body, "session_1_date_time": "1:56 pm on 8 May, 2023"}, "qa": qa}


def test_speakers_end_to_end(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([sample(1), sample(2), {**sample(3), "conversation": {"speaker_a": "A", "speaker_b": "B"}}]))
    (tmp_path / "later.json").write_text(json.dumps({"samples": [sample(1), sample(9)]}))
    source, memory, out = str(tmp_path / "s.json"), str(tmp_path / "m"), str(tmp_path / "out")
    first = jobs.encode(spark, "speakers", source, memory, "2024-02-01 00:00:00").first()
    assert (first.n_graphs, first.n_nodes, first.n_failed) == (2, 8, 1)
    assert [(r.graph_id, r.error) for r in Segments(spark, f"{memory}/encode_samples").read("samples").where("error IS NOT NULL").collect()] == [("s3", "no turn")]
    nodes, edges = memory_graph(Segments(spark, memory))
    before = {(r.graph_id, r.src, r.dst): r.weight for r in edges.collect()}
    assert nodes.count() == 8 and len(before) == 12
    known = knowledge(Segments(spark, memory))
    assert known["profiles"].count() == 2 and known["fallback"].count() == 0
    got = jobs.evaluate_speakers(spark, str(tmp_path / "later.json"), memory, out, "2024-02-01 00:00:00").first()
    assert (got.n, got.n_samples, got.n_failed) == (2, 1, 1) and [c.category for c in got.per_category] == ["Adversarial", "Multi-hop"]
    book = jobs.results(spark, out)
    assert [tuple(r) for r in book.read("failed").collect()] == [("s9", "not stored")]
    rows = book.read("results").orderBy("qa_index").collect()
    means = M.summary(book.read("results")).first()
    assert (got.f1_mean, got.bleu1_std) == (means.f1_mean, means.bleu1_std) and rows[1].running_f1 == pytest.approx((rows[0].f1 + rows[1].f1) / 2)
    assert [r.answer for r in rows] == ["Lyon", "A likes the river"] and all("Lyon" in r.system_answer and len(r.retrieved) == 4 and 0 < r.f1 < 1 for r in rows)
    after = {(r.graph_id, r.src, r.dst): r.weight for r in memory_graph(Segments(spark, memory))[1].collect()}
    assert all(after[k] == w for k, w in before.items() if k[0] == "s2")  # not asked
    assert after["s1", 0, 1] == pytest.approx(0.5 + 2 * 0.02) and after["s1", 0, 3] == pytest.approx(2 * 0.02)


def test_sessions_end_to_end(spark, tmp_path):
    turns = [{"role": r, "content": f"{r} says that the garden needs water every day {k}"} for k in range(5) for r in ("user", "assistant")]
    item = lambda i, kind, sessions: {"question_id": i, "question": "What needs water?", "answer": "the garden", "question_type": kind, "question_date": "2023", "haystack_dates": ["2023-05-08"], "haystack_sessions": sessions}
    items = [item("q1", "multi-session", [turns, turns]), item("q2_abs", "temporal-reasoning", [turns]), item("q3", "temporal-reasoning", [turns]), item("q4", "multi-session", [[]])]
    (tmp_path / "items.json").write_text(json.dumps(items))
    (tmp_path / "more.json").write_text(json.dumps([*items, item("q5", "multi-session", [turns])]))
    memory, out = str(tmp_path / "m"), str(tmp_path / "out")
    jobs.encode(spark, "sessions", str(tmp_path / "items.json"), memory, "2024-02-01 00:00:00")
    with pytest.raises(ValueError, match="unknown graph_id: nobody"):
        jobs.encode(spark, "sessions", str(tmp_path / "items.json"), memory, "2024-02-01 00:00:00", ids=["q1", "nobody"])
    judge = lambda: lambda p: "Yes." if "can't be answered" not in p else "no"
    rows = jobs.evaluate_sessions(spark, str(tmp_path / "more.json"), memory, out, "2024-02-01 00:00:00", corrupted=["q3"], judge=judge).collect()
    assert {r.question_type: (r.n, r.n_correct) for r in rows} == {"multi-session": (3, 1), "temporal-reasoning": (2, 0), None: (5, 1)}
    summary = spark.read.json(f"{out}/summary").first()
    assert summary["items"].asDict() == {"corrupted": 1, "empty": 1, "evaluated": 2, "missing": 1} and summary.n_failed == 0
    assert jobs.results(spark, out).read("results").count() == 2
    known = knowledge(Segments(spark, memory))
    assert known["nodes"].where("graph_id = 'q1'").count() > 0 and {r[0] for r in known["nodes"].select("role").distinct().collect()} == {"system"}


def test_stored_state(spark, tmp_path):
    nodes, edges = memory_graph(Segments(spark, str(tmp_path / "none")))
    assert nodes.count() == edges.count() == 0 and nodes.schema["embedding"].dataType.simpleString() == "array<float>"
    n = spark.createDataFrame([(g, i) for g in ("x", "y") for i in range(2)], "graph_id string, node_id long")
    e = spark.createDataFrame([("x", 0, 1, 0.5), ("y", 0, 1, 0.5)], "graph_id string, src long, dst long, weight double")
    store = Segments(spark, str(tmp_path / "g"))
    store.commit({"nodes": n, "edges": e})
    store.commit({"nodes": n.where("graph_id = 'x'"), "edges": e.limit(0)})  # all edges of x are gone
    assert [r.graph_id for r in store.read("edges").collect()] == ["y"]
    store.commit({"nodes": n.limit(0), "edges": e.limit(0)}, graphs=n.where("graph_id = 'y'"))
    for _ in range(2):
        nodes, edges = memory_graph(store)
        assert {r.graph_id for r in nodes.collect()} == {"x"} and edges.count() == 0
        assert {r[0] for r in store.graphs().collect()} == {"x", "y"}
        store.compact()
    assert store.read("nodes", ["x", "other"]).count() == 2 and store.read("nodes", ["y"]).count() == 0


def test_stored_identifiers(spark, tmp_path):
    """Identifiers that look like numbers or dates come back as they are."""
    ids = ["01", "1", "1e5", "2024-01-01", "a/b=c", "é"]
    store = Segments(spark, str(tmp_path / "s"))
    store.commit({"nodes": spark.createDataFrame([(i, 0) for i in ids], "graph_id string, node_seq long")})
    assert sorted(r.graph_id for r in store.read("nodes").collect()) == sorted(ids) == sorted(r[0] for r in store.graphs().collect())
    assert [r.graph_id for r in store.read("nodes", ["01"]).collect()] == ["01"]
    store = Segments(spark, str(tmp_path / "n"), key="long")
    store.commit({"nodes": spark.createDataFrame([(7, 0)], "graph_id long, node_seq long")})
    again = Segments(spark, str(tmp_path / "n"))
    assert again.read("nodes").first().graph_id == 7 and again.read("nodes").schema["graph_id"].dataType.simpleString() == "bigint"


def files(path):
    return {str(f.relative_to(path)) for f in path.rglob("*") if f.is_file() and not f.name.startswith(".")}


def test_commits(spark, tmp_path):
    """All tables change at one go; a writer that dies leaves the old state; increments are all that reinforcing writes."""
    store = Segments(spark, str(tmp_path))
    kind = "graph_id string, src long, dst long, weight double"
    n = spark.createDataFrame([("g", i) for i in range(3)], "graph_id string, node_id long")
    store.commit({"nodes": n, "edges": spark.createDataFrame([("g", 0, 1, 0.9), ("g", 1, 0, 0.9)], kind)})
    before = files(tmp_path)
    for _ in range(2):
        store.commit(add={"edges": spark.createDataFrame([("g", 0, 1, 0.07), ("g", 1, 2, 0.07)], kind)})
    assert {(r.src, r.dst): round(r.weight, 9) for r in store.read("edges").collect()} == {(0, 1): 1.0, (1, 0): 0.9, (1, 2): 0.14}
    assert before <= files(tmp_path) and not any("/nodes/" in f for f in files(tmp_path) - before)
    seen = store.manifest()
    bad = n.withColumn("weight", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"nodes": n.limit(1), "edges": bad.selectExpr("graph_id", "node_id AS src", "node_id AS dst", "weight")}, graphs=n)
    assert store.manifest() == seen and store.read("nodes").count() == 3
    late = Segments(spark, str(tmp_path))
    late.manifest = lambda: seen  # read before the next commit of the other writer
    store.compact()
    with pytest.raises(ConflictingCommit):
        late.commit({"nodes": n.limit(1)})
    assert {(r.src, r.dst): round(r.weight, 9) for r in store.read("edges").collect()} == {(0, 1): 1.0, (1, 0): 0.9, (1, 2): 0.14}
    assert len(store.vacuum(hours=-1)) == 5 and store.read("nodes").count() == 3  # three commits, a dead writer, a late one
    store.commit({"nodes": n.limit(1)})  # replaces what was increments, too
    store.commit({"edges": spark.createDataFrame([("g", 0, 1, 0.2)], kind)})
    assert [r.weight for r in store.read("edges").collect()] == [0.2] and store.read("nodes").count() == 1


def test_batches_count_once(spark, tmp_path):
    store, n = Segments(spark, str(tmp_path)), spark.createDataFrame([("g", 1)], "graph_id string, node_id long")
    versions = [store.commit(add={"nodes": n}, batch=("w", i)) for i in (0, 0, 1, 0)] + [store.commit(add={"nodes": n}, batch=("other", 0))]
    assert versions == [1, 1, 2, 2, 3] and store.read("nodes").count() == 3


def test_many_failures(spark, tmp_path):
    """Every failed sample is a row with its error, however many; totals need no scan of their own; a run replaces its own samples only."""
    (tmp_path / "s.json").write_text(json.dumps([sample(i) if i < 2 else {**sample(i), "conversation": {"speaker_a": "A"}} for i in range(152)]))
    memory, out = str(tmp_path / "m"), str(tmp_path / "out")
    got = jobs.encode(spark, "speakers", str(tmp_path / "s.json"), memory, "2024-02-01 00:00:00", skip_knowledge=True).first()
    assert (got.n_graphs, got.n_failed, got.n_nodes) == (2, 150, 8)
    rows = Segments(spark, f"{memory}/encode_samples").read("samples").collect()
    assert sum(r.error == "no turn" for r in rows) == 150 and {(r.graph_id, r.n_nodes) for r in rows if r.error is None} == {("s0", 4), ("s1", 4)}
    (tmp_path / "q.json").write_text(json.dumps([sample(i) for i in range(1000, 1150)] + [sample(0), sample(1)]))
    summary = jobs.evaluate_speakers(spark, str(tmp_path / "q.json"), memory, out, "now").first()
    book = jobs.results(spark, out)
    assert summary.n_failed == 150 and book.read("failed").where("error = 'not stored'").select("graph_id").distinct().count() == 150
    jobs.evaluate_speakers(spark, str(tmp_path / "q.json"), memory, out, "now", ids=["s1"])
    assert {tuple(r) for r in book.read("results").groupBy("graph_id").count().collect()} == {("s0", 2), ("s1", 2)} and book.read("failed").count() == 150
    assert all(r.running_f1 is not None for r in book.read("results").collect())


def test_graph_documents(spark, tmp_path):
    doc = {"nodes": {str(i): {"id": str(i), "content": f"c{i}", "role": "interaction", "embedding": [1.0, 0.0], "timestamp": "t", "keywords": ["k"], "metadata": {}} for i in range(2)}, "edges": {"0": {"1": 0.5}, "1": {"0": 0.5}}}
    (tmp_path / "g7_memory.json").write_text(json.dumps(doc))
    n, e = store.read_graph_documents(spark, str(tmp_path / "g7_memory.json"))
    assert sorted((r.graph_id, r.node_id, r.content) for r in n.collect()) == [("g7", 0, "c0"), ("g7", 1, "c1")]
    assert sorted((r.src, r.dst, r.weight) for r in e.collect()) == [(0, 1, 0.5), (1, 0, 0.5)]


def test_malformed_samples_raise(spark, tmp_path):
    for text in ('{"other": 1}', "[1, 2", '"text"'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(Exception):
            store.read_samples(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "s.json").write_text(json.dumps([{k: v for k, v in sample(i).items() if k != "sample_id"} for i in (1, 1, 2)]))
    ids = [r[0] for r in store.read_samples(spark, str(tmp_path / "s.json")).select("sample_id").collect()]
    assert len(set(ids)) == 2 and all(i.startswith("sample_") for i in ids)


def test_replies_tell_errors(spark):
    def make():
        return lambda p: p.upper() if p != "bad" else 1 / 0

    got = [tuple(r[0]) for r in spark.createDataFrame([("ok",), ("bad",), (None,)], "v string").select(models.replies(F.col("v"), make)).collect()]
    assert got[0] == ("OK", None) and got[1][0] == "" and "ZeroDivisionError" in got[1][1] and got[2] == ("", "no prompt")


def test_assistant_knowledge_append(spark):
    kinds = "graph_id long, ak_seq long, knowledge string"
    old, new = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], kinds), spark.createDataFrame([(1, 0, "c"), (1, 1, " - None "), (1, 2, "d"), (2, 5, "e")], kinds)
    got = sorted(map(tuple, K.add_assistant_knowledge(old, new, 3).collect()))
    assert got == [(1, 1, "b"), (1, 2, "c"), (1, 3, "d"), (2, 0, "e")]


def test_stored_profile_goes_on(spark):
    found = spark.createDataFrame([("g", 0, "new")], "graph_id string, batch long, profile string")
    stored = spark.createDataFrame([("g", "old"), ("h", "kept")], "graph_id string, data string")
    got = {r.graph_id: r.data for r in encode.fold_extracted(found, lambda: lambda p: "|".join(p.split("\n")[-2:]), stored).collect()}
    assert got == {"g": "old|new", "h": "kept"}


def test_forgetting_dry_run(spark):
    n = spark.createDataFrame([("g", i, "2020-01-01 00:00:00", 0, "text " * 30) for i in range(3)], "graph_id string, node_id long, ts string, access_count int, content string").withColumn("node_seq", F.col("node_id"))
    e = spark.createDataFrame([("g", 0, 1, 0.5), ("g", 1, 0, 0.5)], "graph_id string, src long, dst long, weight double")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert G.adaptive_forgetting(n, e, now)[0].count() == 0  # off unless enabled
    gone, left, _ = G.adaptive_forgetting(n, e, now, enabled=True)
    assert [r.node_id for r in gone.collect()] == [2] and left.count() == 3
    assert G.adaptive_forgetting(n, e, now, enabled=True, dry_run=False)[1].count() == 2
    row = G.forgetting_preview(n, e, gone).first()
    assert (row.node_id, row.n_edges, len(row.preview)) == (2, 0, 50)


@pytest.mark.parametrize("name", ["forget_candidates", "forget_apply", "forget_preview"])
def test_forgetting_at_the_least_weight(spark, tmp_path, name):
    """The middle node's weights are 0.00001 and 0.09999, whose doubles add up to less than 0.1; the second user's are less than 0.1."""
    rows = [(10 * u + i, u, f"2024-01-0{i + 1} 00:00:00", v) for u, vs in enumerate([(0.0, 0.01, 99.99, 500.0), (0.0, 0.02, 99.97, 500.0)]) for i, v in enumerate(vs)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    events.withColumns({"event_type": F.lit("click"), "props": F.lit("{}")}).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"SET timezone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).select(*columns).collect())) == sorted(want.fetchall())


def test_cells_of_a_large_graph(spark, monkeypatch):
    n, e = catalog.vec_nodes(spark, SF), catalog.vec_nodes(spark, SF)
    e = G.temporal_edges(n)
    found = lambda: sorted((r.graph_id, r.src, r.dst, round(r.weight, 9)) for r in G.similarity_edges(n, e, catalog.LINKED).collect())
    want = found()
    monkeypatch.setattr(G, "CELL_NODES", 7)
    assert found() == want and want


def test_cells_that_are_skipped(spark, monkeypatch):
    """Vectors in tight bundles, one of them shared by a third of all nodes: most pairs of cells are skipped, and no edge is lost."""
    r = random.Random(2)
    axes = [[1.0 if j == i else 0.0 for j in range(12)] for i in range(12)]
    rows = [("g", i, i, [x + r.gauss(0, 0.03) for x in axes[i % 12]]) for i in range(240)] + [("g", 240 + i, 240 + i, axes[3]) for i in range(120)]
    rows += [("g", 900, 900, [0.0] * 12), ("h", 1, 1, axes[0]), ("h", 2, 2, axes[0]), ("h", 3, 3, None)]
    n = spark.createDataFrame(rows, "graph_id string, node_id long, node_seq long, embedding array<double>")
    e = spark.createDataFrame([("g", 0, 12, 0.5), ("g", 12, 0, 0.5)], "graph_id string, src long, dst long, weight double")
    found = lambda: sorted((x.graph_id, x.src, x.dst, round(x.weight, 9)) for x in G.similarity_edges(n, e).collect())
    want = found()
    monkeypatch.setattr(G, "CELL_NODES", 10)
    assert found() == want and len(want) > 500
    held = n.where("embedding IS NOT NULL").select("graph_id", "node_id", "node_seq", F.col("embedding").alias("e"))
    _, cells = G.vector_cells(held, spark.createDataFrame([("g", 37)], "graph_id string, cells int"))
    near = [x.near for x in G.cell_pairs(cells, 0.5).collect()]
    assert len(near) > 300 and sum(near) < len(near) / 2
    ragged = spark.createDataFrame([("g", 1, 1, [1.0, 2.0, 3.0]), ("g", 2, 2, [1.0])], "graph_id string, node_id long, node_seq long, embedding array<double>")
    with pytest.raises(Exception, match="one length"):
        G.similarity_edges(ragged, e).collect()


def test_blocks_of_a_large_graph(spark, monkeypatch, tmp_path):
    """Twice the nodes of a graph are sent to tasks twice, not four times, and blocks that are full are divided without a loss."""
    r = random.Random(3)
    vectors = [[r.gauss(0, 1) for _ in range(6)] for _ in range(480)]
    monkeypatch.setattr(G, "CELL_NODES", 10)

    def graph(size):
        n = spark.createDataFrame([("g", i, i, v) for i, v in enumerate(vectors[:size])], "graph_id string, node_id long, node_seq long, embedding array<double>")
        return n, spark.createDataFrame([("g", 0, 1, 0.5)], "graph_id string, src long, dst long, weight double")

    def sent(size):
        folder, near = tmp_path / str(size), G._near

        def counted(most, cutoff):
            work = near(most, cutoff)

            def count(table):
                (folder / uuid.uuid4().hex).write_text(str(table.num_rows))
                return work(table)

            return count

        folder.mkdir()
        with monkeypatch.context() as m:
            m.setattr(G, "_near", counted)
            links = sorted((x.src, x.dst, round(x.weight, 9)) for x in G.similarity_edges(*graph(size)).collect())
        return sum(int(f.read_text()) for f in folder.iterdir()), links

    (less, _), (more, links) = sent(240), sent(480)
    assert 480 <= less and more < 2.5 * less
    monkeypatch.setattr(G, "BLOCK_BYTES", 6 * 8 * 40)
    (tmp_path / "480").rename(tmp_path / "whole")
    divided, same = sent(480)
    assert divided > 2 * more and same == links
    monkeypatch.setattr(G, "CELL_NODES", 1_000)
    assert sorted((x.src, x.dst, round(x.weight, 9)) for x in G.similarity_edges(*graph(480)).collect()) == links and links


@pytest.mark.parametrize("blocks", [1, 2])
@pytest.mark.parametrize("cutoff", [-0.5, 0.3])
def test_partners_in_tiles(monkeypatch, blocks, cutoff):
    """The partners that plain loops find, five a node at most though half of all nodes share a vector; a vector that is no number has none."""
    monkeypatch.setattr(G, "TILE", 7)
    monkeypatch.setattr(G, "COLUMNS", 16)
    r = random.Random(5)
    e = [[1.0, 2.0, 2.0] if i % 2 else [r.gauss(0, 1) for _ in range(3)] for i in range(120)]
    e[8], e[20] = [0.0] * 3, [float("nan"), 1.0, 1.0]
    seqs = r.sample(range(1_000), 120)
    second = [blocks == 2 and i >= 70 for i in range(120)]
    cells = [r.randrange(3) + 10 * s for s in second]
    table = pa.table({"graph_id": ["g"] * 120, "node_id": list(range(500, 620)), "node_seq": seqs, "e": e, "cell": cells, "second": second})
    got = G._near(5, cutoff)(table).to_pylist()
    want = set()
    for i, a in enumerate(e):
        near = []
        for j, b in enumerate(e):
            if i != j and (blocks == 1 or second[i] != second[j]):
                size = max(math.sqrt(sum(x * x for x in a)), 1e-10) * max(math.sqrt(sum(x * x for x in b)), 1e-10)
                sim = sum(x * y for x, y in zip(a, b, strict=True)) / size
                near += [(-round(sim, 12), -seqs[j], j)] if sim > cutoff else []
        want |= {(500 + i, 500 + j, seqs[j]) for _, _, j in sorted(near)[:5]}
    assert {(x["src"], x["dst"], x["dseq"]) for x in got} == want and len(got) == len(want) > 300


NASTY = ['"', "\\", "}{][", '\\"}', "é\u2028", '{"a": [1, "}"]}', "\n\t", "", "\\\\"]


@pytest.mark.parametrize("indent", [None, 1])
def test_large_arrays_are_split(spark, tmp_path, indent):
    """The same rows as from one task, in the order of the file, whatever the texts hold and wherever a split falls."""
    r = random.Random(4)
    text = lambda: "".join(r.choices([*NASTY, "word ", "x" * 40], k=r.choice([0, 1, 5, 30])))
    items = [{"question_id": f"q{i}", "question": text(), "answer": text(), "haystack_dates": [text()], "haystack_sessions": [[{"role": "user", "content": text()}] * r.choice([0, 1, 9])]} for i in range(60)]
    items.insert(30, {"question_id": "long", "question": "y}" * 6000, "haystack_sessions": [[{"role": "user", "content": "{" * 9000}]]})  # over several splits
    (tmp_path / "big.json").write_text(json.dumps(items, indent=indent, ensure_ascii=indent is None))
    (tmp_path / "wrapped.json").write_text(json.dumps({"samples": [{**sample(i), "sample_id": f"w{i}"} for i in range(3)]}))
    (tmp_path / "list.json").write_text(json.dumps([{**sample(i), "sample_id": f"s{i}"} for i in range(9)], indent=indent))
    (tmp_path / "nameless.json").write_text(json.dumps([{k: v for k, v in sample(i).items() if k != "sample_id"} for i in range(9)], indent=indent))
    rows = lambda df: [tuple(x)[:-1] for x in df.orderBy("source_at").collect()]

    def read():
        samples = store.read_samples(spark, f"{tmp_path}/[lwn]*.json")
        parts = [store.dialogs(samples), store.questions(samples)]
        return [rows(store.read_items(spark, str(tmp_path / "big.json"))), [r.sample_id for r in samples.orderBy("source_at").collect()], *[sorted(map(str, p.collect())) for p in parts]]

    want = read()
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (2000, 1777, 450):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 0)
            assert array_elements(spark, [str(tmp_path / "big.json")]).rdd.getNumPartitions() > 4 and read() == want
        for bad in ("[{]" + " " * 500, '[{"question_id": "a}]' + " " * 500, "[1, 2" + " " * 500 + "]", "[" + '{"question_id": 1},' * 50):
            (tmp_path / "bad.json").write_text(bad)
            with pytest.raises(Exception):
                store.read_items(spark, str(tmp_path / "bad.json")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [x[0] for x in want[0]] == [x["question_id"] for x in items]


def test_slices_go_by_file(spark, tmp_path):
    for name, ids in (("a", "z b m".split()), ("b", "y a".split())):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"question_id": i} for i in ids]))
    (tmp_path / "s.json").write_text(json.dumps({"samples": [{**sample(0), "sample_id": i} for i in "z b m a".split()]}))
    picked = lambda style, path, start, n: {r.graph_id for r in jobs._source(spark, style, str(path), None, start, n).collect()}
    assert picked("sessions", f"{tmp_path}/[ab].json", 1, 3) == {"b", "m", "y"} and picked("sessions", f"{tmp_path}/[ab].json", 4, None) == {"a"}
    assert picked("speakers", tmp_path / "s.json", 0, 1) == {"z"} and picked("speakers", tmp_path / "s.json", 2, 2) == {"m", "a"}


def test_greedy_clusters_against_loops(spark):
    n, e = catalog._linked(spark, SF)
    hubs = G.hubs(G.degrees(n, e)).collect()
    near = {}
    for r in e.collect():
        near.setdefault((r.graph_id, r.src), []).append((-round(r.weight, 12), r.dst))
    want = []
    for g in sorted({r.graph_id for r in hubs}):
        done = set()
        for h in sorted((r for r in hubs if r.graph_id == g), key=lambda r: r.hub_rank):
            if h.node_id in done:
                continue
            members = [h.node_id] + [d for _, d in sorted(near[g, h.node_id])[:7] if d not in done and d != h.node_id]
            done.update(members)
            if len(members) >= 2:
                want.append((g, h.node_id, ",".join(map(str, members))))
    got = [tuple(r) for r in catalog.QUERIES["greedy_clusters"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20


def test_consolidation_plan_against_loops(spark):
    clusters = catalog.QUERIES["greedy_clusters"](spark, SF).collect()
    want = {(r.graph_id, r.hub): "\n".join(f"node {m}" for m in r.members.split(",")) for r in clusters}
    assert {(r.graph_id, r.hub): r.texts for r in catalog.QUERIES["consolidation_plan"](spark, SF).collect()} == want


def conversations(spark):
    """Turns of each conversation by plain loops."""
    by_conv, turns = {}, {}
    for r in catalog.read(spark, SF, "conversations").collect():
        by_conv.setdefault(r.conv_id, []).append(r)
    for conv, rows in by_conv.items():
        rows.sort(key=lambda r: r.turn)
        turns[conv] = [(a.text, b.text) for a, b in zip(rows, rows[1:], strict=False) if (a.role, b.role) == ("user", "assistant")]
    return {k: v for k, v in turns.items() if v}


def test_memory_graph_against_loops(spark):
    encode_one = models.hashed_encoder()
    got = {}
    for r in catalog.QUERIES["memory_graph"](spark, SF).collect():
        got.setdefault(r.graph_id, {})[r.node_seq] = r
    turns = conversations(spark)
    assert set(got) == set(turns)
    for conv, pairs in turns.items():
        assert sorted(got[conv]) == list(range(len(pairs)))
        for k, (user, ai) in enumerate(pairs):
            r, text = got[conv][k], f"User: {user}\nAI: {ai}"
            v = encode_one([text])[0]
            assert (r.content, r.role, r.node_id) == (text, "interaction", k)
            assert r.embedding == pytest.approx((v / ((v**2).sum() ** 0.5 or 1)).tolist(), abs=1e-6)


def first_lines(text):
    return [x.strip() for x in text.splitlines() if x.strip()][:3]


def test_extraction_against_loops(spark):
    """Buffers of ten turns, the default model's three lines of each, and the profile that is folded from them."""
    turns = conversations(spark)
    facts, profiles = [], {}
    for conv, pairs in turns.items():
        profile = ""
        for batch in range(-(-len(pairs) // 10)):
            found = first_lines("\n".join(f"User: {u}\nAI: {a}" for u, a in pairs[10 * batch : 10 * batch + 10]))
            facts += [(conv, batch, k, x.lstrip("- ").strip(), "assistant") for k, x in enumerate(found)]
            new = "\n".join(f"- {x}" for x in found)
            profile = "\n".join(f"- {x}" for x in first_lines(f"{profile}\n{new}")) if profile else new
        profiles[conv] = profile
    got = catalog.QUERIES["extracted_facts"](spark, SF).collect()
    assert sorted((r.graph_id, r.batch, r.line_no, r.content, r.kind) for r in got) == sorted(facts)
    assert {r.graph_id: r.data for r in catalog.QUERIES["profile_fold"](spark, SF).collect()} == profiles


def test_consolidated_facts_against_loops(spark):
    plan = catalog.QUERIES["greedy_clusters"](spark, SF).collect()
    want = []
    for r in plan:
        texts = "\n\n---\n\n".join(f"passage of node {m}" for m in r.members.split(","))
        want += [(r.graph_id, r.hub, k, x) for k, x in enumerate(first_lines(texts)) if len(x) > 10]
    got = [(r.graph_id, r.hub, r.line_no, r.content) for r in catalog.QUERIES["consolidate"](spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_answers_against_loops(spark):
    """The prompt's parts and the answer, which is the first line of the best memory."""
    turns = conversations(spark)
    got = {r.query_id: r for r in catalog.QUERIES["answer_question"](spark, SF).collect()}
    assert set(got) == set(turns)
    for conv, r in got.items():
        users = [u.split("\n")[0] for u, _ in turns[conv]]
        assert r.prompt.startswith(answer.INSTRUCTION) and r.prompt.endswith(f"Today: 2024-02-01\n\nQuestion: {turns[conv][-1][0]}")
        assert "About the assistant:\n- " in r.prompt and "About the user:\n- " in r.prompt and r.error is None and r.answer in users


def test_remember_goes_on(spark):
    kinds = "graph_id string, session_seq int, turn_seq int, ts string, user_text string, ai_text string"
    n, e = encode.memory_graph(spark.createDataFrame([("x", 1, i, None, f"u{i}", "a") for i in range(2)] + [("y", 1, 0, None, "v", "a")], kinds))
    e = e.withColumn("weight", F.lit(0.7))
    nodes, edges = encode.remember((n, e), spark.createDataFrame([("x", 2, i, "t", f"w{i}", "a") for i in range(2)] + [("z", 1, 0, "t", "z", "a")], kinds))
    assert sorted((r.graph_id, r.node_id, r.content.split("\n")[0]) for r in nodes.collect()) == [("x", 0, "User: u0"), ("x", 1, "User: u1"), ("x", 2, "User: w0"), ("x", 3, "User: w1"), ("y", 0, "User: v"), ("z", 0, "User: z")]
    assert {(r.src, r.dst): r.weight for r in edges.where("graph_id = 'x' AND src < dst").collect()} == {(0, 1): 0.7, (1, 2): 0.5, (2, 3): 0.5}
    assert edges.where("graph_id <> 'x'").count() == 0


def test_decay_mode(spark):
    n = catalog.vec_nodes(spark, SF).withColumn("ts", F.lit("2024-01-01 00:00:00"))
    q = catalog.vec_queries(n).withColumn("asked_at", F.lit("2024-01-02 00:00:00").cast("timestamp"))
    plain = {(r.query_id, r.node_id): r.enh for r in R.base_scores(n, q).collect()}
    decayed = {(r.query_id, r.node_id): r.enh for r in R.base_scores(n, q, replace(catalog.DEFAULT, decay_mode="exponential", tau=86400.0)).collect()}
    assert all(decayed[k] == pytest.approx(v / 2.718281828459045) for k, v in plain.items())


def test_keys_in_turn(spark, tmp_path):
    (tmp_path / "keys").write_text("a\n\n b \n")
    assert models.key_list(" x, ,y", str(tmp_path / "keys"), "z") == ["x", "y"]
    assert models.key_list(None, str(tmp_path / "keys"), "z") == ["a", "b"] and models.key_list("", None, " z ") == ["z"] and models.key_list() == []

    def make():
        def one(key):
            return lambda p: 1 / 0 if key == "bad" else f"{key}: {p}"

        return models.rotating(one, ["bad", "good"])

    got = [r[0] for r in spark.createDataFrame([("p",), ("q",)], "v string").coalesce(1).select(models.completion(F.col("v"), make)).collect()]
    assert got == ["good: p", "good: q"]
    with pytest.raises(ValueError):
        models.rotating(lambda key: None, [])


def test_model_keywords(spark):
    turns = spark.createDataFrame([("x", 1, 0, None, "tea", "a"), ("x", 1, 1, None, "bad", "a")], "graph_id string, session_seq int, turn_seq int, ts string, user_text string, ai_text string")
    nodes = encode.memory_graph(turns, keyword_model=lambda: lambda p: 1 / 0 if "bad" in p else " tea, pot ,, tea, cup, milk")[0]
    assert {r.node_id: r.keywords for r in nodes.collect()} == {0: ["tea", "pot", "cup", "milk"], 1: []}



def test_scored_answers_against_counters(spark):
    def words(s):
        s = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", s.lower())).strip()
        return re.sub(r"(^|\s)(a|an|the)(\s|$)", " ", s).split()

    turns = conversations(spark)
    said = {r.query_id: r.answer for r in catalog.QUERIES["answer_question"](spark, SF).collect()}
    got = {r.query_id: (r.f1, r.bleu1) for r in catalog.QUERIES["scored_answers"](spark, SF).collect()}
    assert set(got) == set(turns)
    for conv, pairs in turns.items():
        p, r = words(said[conv]), words(pairs[-1][1])
        n = sum((Counter(p) & Counter(r)).values())
        f1 = 1.0 if not p and not r else 2 * n / (len(p) + len(r)) if n else 0.0
        bleu = 0.0 if not p or not r else (math.exp(1 - len(r) / len(p)) if len(p) < len(r) else 1.0) * n / len(p)
        assert got[conv] == pytest.approx((f1, bleu), abs=1e-8)


def rounds(nodes, edges, queries, k, c):
    """Round by round: retrieval over the edges as all earlier rounds have left them."""
    out = []
    for i in sorted({r[0] for r in queries.select("qa_index").distinct().collect()}):
        res = R.retrieve(nodes, edges, queries.where(F.col("qa_index") == i), k, c).collect()
        out += [(r.query_id, i, r.node_id, r.out_rank, r.score, r.base_score, r.flipped, r.source) for r in res]
        spark = nodes.sparkSession
        pairs = G.reinforce_pairs(spark.createDataFrame(res), c.learning_rate) if res else None
        edges = spark.createDataFrame(G.upsert(edges, pairs).collect(), "graph_id long, src long, dst long, weight double") if res else edges
    return sorted(out), {(r.graph_id, r.src, r.dst): round(r.weight, 9) for r in edges.collect()}


def test_fold_equals_rounds(spark, monkeypatch):
    """Six queries, of which two share a number; a steep rate, so that reinforced pairs do turn up by spreading and weights reach 1."""
    c = replace(catalog.DEFAULT, learning_rate=0.3, alpha=0.6, spread_threshold=0.45)
    n = catalog.vec_nodes(spark, SF).where("graph_id < 3").select("*", F.array(F.concat(F.lit("k"), F.col("node_seq") % 5)).alias("keywords"))
    q = n.where("node_seq IN (2, 5, 9, 14, 20, 21)").select(F.concat(F.lit("q"), "node_id").alias("query_id"), "graph_id", F.when(F.col("node_seq") == 21, 20).otherwise(F.col("node_seq")).alias("qa_index"), F.col("embedding").alias("q_embedding"), F.col("keywords").alias("q_keywords"))
    n, e, q = (spark.createDataFrame(df.collect(), df.schema) for df in (n, G.temporal_edges(n), q))
    want, edges = rounds(n, e, q, 4, c)
    for cell in (200, 3):
        monkeypatch.setattr(folds, "CELL", cell)
        found, gains = folds.sequential(n, e, q, 4, c)
        got = sorted((r.query_id, r.qa_index, r.node_id, r.out_rank, r.score, r.base_score, r.flipped, r.source) for r in found.collect())
        assert got == want and any(r[6] for r in got)
        assert {(r.graph_id, r.src, r.dst): round(r.weight, 9) for r in G.upsert(e, gains).collect()} == edges and 1.0 in edges.values()


def test_fold_of_many_queries(spark):
    """The jobs of a fold don't grow with the questions of a graph."""
    dims = 8
    vector = F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda i: F.sin(F.col("node_id") * i).cast("float"))
    n = spark.range(300).select(F.lit("g").alias("graph_id"), F.col("id").alias("node_id"), F.col("id").alias("node_seq")).withColumn("embedding", vector)
    sc, counts = spark.sparkContext, []
    for most in (5, 150):
        q = n.where(F.col("node_seq") < most).select(F.col("node_id").alias("query_id"), "graph_id", F.col("node_seq").alias("qa_index"), F.col("embedding").alias("q_embedding"))
        sc.setJobGroup(f"fold {most}", "")
        assert folds.sequential(n, G.temporal_edges(n), q, 5)[0].select("query_id").distinct().count() == most
        counts.append(len(sc.statusTracker().getJobIdsForGroup(f"fold {most}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] <= counts[0] + 3


def test_fold_without_queries(spark):
    n = catalog.vec_nodes(spark, SF)
    q = catalog.vec_queries(n).withColumn("qa_index", F.lit(0)).limit(0)
    found, gains = folds.sequential(n, G.temporal_edges(n), q)
    assert found.count() == 0 and gains.count() == 0 and "qa_index" in found.columns
    found, gains = folds.sequential(n.limit(0), G.temporal_edges(n), catalog.vec_queries(n).withColumn("qa_index", F.lit(0)))
    assert found.count() == 0


def counted(path, reply):
    """A model that notes each call in a file of its own."""

    def make():
        def ask(prompt):
            with open(f"{path}/{hashlib.sha256(prompt.encode()).hexdigest()[:12]}-{uuid.uuid4().hex}", "w"):
                pass
            return reply(prompt)

        return ask

    return make


def test_model_cache(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    calls = lambda: len(list((tmp_path / "calls").iterdir()))
    model = counted(tmp_path / "calls", lambda p: p.upper() if p != "bad" else 1 / 0)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "a", "bad", None] + ["b"] * 30)], "i long, t string").repartition(4)
    cache = ModelCache(spark, str(tmp_path / "c"), "one")
    for more, others in ((2 + 3, "one"), (3, "one"), (5, "two")):  # a failed prompt is tried three times, and again later
        before, cache = calls(), ModelCache(spark, str(tmp_path / "c"), others)
        got = {r.i: (r.t, r.r) for r in cache.replies(rows, F.col("t"), model).collect()}
        assert calls() == before + more and len(got) == 35
        assert all(r["reply"] == t.upper() and r["error"] is None for t, r in got.values() if t in ("a", "b")) and "ZeroDivisionError" in got[3][1]["error"] and got[4][1] is None


def test_encoding_twice_asks_once(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    (tmp_path / "s.json").write_text(json.dumps([sample(1, 12), sample(2)]))
    model = counted(tmp_path / "calls", models.extractive_model())
    stored = []
    for k in range(2):
        memory = str(tmp_path / f"m{k}")
        jobs.encode(spark, "speakers", str(tmp_path / "s.json"), memory, "2024-02-01 00:00:00", model=model, cache=str(tmp_path / "cache"), version="v")
        stored.append((len(list((tmp_path / "calls").iterdir())), *(sorted(map(str, Segments(spark, memory).read(t).select("graph_id", *c).collect())) for t, c in (("nodes", ["node_id", "embedding"]), ("profiles", ["data"]), ("facts", ["content", "embedding"])))))
    assert stored[0] == stored[1] and stored[0][0] > 4


def test_fold_goes_on(spark, tmp_path, monkeypatch):
    """After a failure the model is called only for the batches behind the last stored chunk; changed batches are folded anew."""
    monkeypatch.setattr(encode, "FOLD", 2)
    (tmp_path / "calls").mkdir()
    calls = lambda: len(list((tmp_path / "calls").iterdir()))
    frame = lambda texts: spark.createDataFrame([("g", i, t) for i, t in enumerate(texts)] + [("h", 0, "x")], "graph_id string, batch long, profile string")
    join = lambda p: "|".join(p.split("\n")[-2:])
    progress = Segments(spark, str(tmp_path / "p"), encode.PROGRESS)

    def lost():
        raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        encode.fold_extracted(frame("abcdefg"), counted(tmp_path / "calls", lambda p: lost() if p.endswith("f") else join(p)), progress=progress).collect()
    before = calls()
    assert before >= 5  # b, c, d, e and the failing f, tried again by Spark
    got = {r.graph_id: r.data for r in encode.fold_extracted(frame("abcdefg"), counted(tmp_path / "calls", join), progress=progress).collect()}
    assert got == {"g": "a|b|c|d|e|f|g", "h": "x"} and calls() == before + 3  # e, f, g
    got = {r.graph_id: r.data for r in encode.fold_extracted(frame("aBc"), counted(tmp_path / "calls", join), progress=progress).collect()}
    assert got == {"g": "a|B|c", "h": "x"}
