import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from engram import catalog
from engram.functions import text as T
from engram.operators import graph as G
from engram.operators import metrics as M
from engram.operators.dialogue import pair_fifo

SF = "/root/testdata/sf0.001"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize("text, want", [("The cat, AN apple!", "cat apple"), ("a the cat an", "the cat")])
def test_normalize(spark, text, want):
    assert one(spark, text, T.normalize) == want


@pytest.mark.parametrize("text, want", [("Yes.", True), ("y", True), ("No", False), ("Yes, it is", True), ("No, yes", True), ("no yes", False), ("", False), (None, False), ("correct", False)])
def test_judged(spark, text, want):
    assert one(spark, text, T.judged) is want


@pytest.mark.parametrize("text, want", [("-- - fact", "fact"), ("- None", None), ("【H】", None)])
def test_clean_line(spark, text, want):
    assert one(spark, text, T.clean_line) == want


def test_scores(spark):
    rows = [(1, "", ""), (2, "", "x"), (3, "x x y", "x y z"), (4, "x", "x y")]
    got = {r["id"]: (r["f1"], r["bleu1"]) for r in M.token_scores(spark.createDataFrame(rows, "id int, prediction string, reference string")).collect()}
    assert got[1] == (1.0, 0.0) and got[2] == (0.0, 0.0)
    assert got[3][0] == pytest.approx(2 / 3) and got[4][1] == pytest.approx(2.718281828459045**-1)


def test_fifo(spark):
    rows = [(1, i + 1, c) for i, c in enumerate("uuaaaua")]
    df = spark.createDataFrame(rows, "g int, i int, r string")
    got = pair_fifo(df, ["g"], [F.col("i")], F.col("r") == "u", "i").select("user_row", "reply_row").collect()
    assert sorted(map(tuple, got)) == [(1, 3), (2, 4), (6, 7)]


def test_edge_cap(spark):
    e = spark.createDataFrame([(1, 1, 2, 0.9), (1, 2, 1, 0.9)], "graph_id long, src long, dst long, weight double")
    d = spark.createDataFrame([(1, 1, 2, 0.5), (1, 3, 3, 0.5)], e.schema)
    assert sorted((r.src, r.dst, r.weight) for r in G.upsert(e, d).collect()) == [(1, 2, 1.0), (2, 1, 1.0)]


def test_retrieval_plan_has_no_python(spark):
    plan = catalog.QUERIES["retrieve_topk"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["retrieve_topk", "pair_adjacent", "judge_accuracy"])
def test_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("text, want", [("　- fact　", "fact"), ("\xa0【H】", None), ("none\xa0", None), ("-\t fact", "fact")])
def test_clean_line_strips_all_scripts(spark, text, want):
    assert one(spark, text, T.clean_line) == want


@pytest.mark.parametrize("text, want", [("it is y:es", False), ("well, yes", True), ("yes\rno", True), ("maybe yes", False), ("...", False), ("　Yes", True)])
def test_judged_lines(spark, text, want):
    assert one(spark, text, T.judged) is want


def test_token_lists_against_counters(spark):
    r = random.Random(5)
    rows = [(i, [r.choice("abcdef") for _ in range(r.randrange(12))], [r.choice("abcdef") for _ in range(r.randrange(12))]) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    got = {x.i: (x.n, x.top) for x in df.select("i", T.common_tokens(F.col("a"), F.col("b")).alias("n"), T.frequent(F.col("a"), 3).alias("top")).collect()}
    for i, a, b in rows:
        top = sorted(Counter(a).items(), key=lambda kv: (-kv[1], kv[0]))[:3]
        assert got[i] == (sum((Counter(a) & Counter(b)).values()), [w for w, _ in top])


def test_scalar_functions(spark):
    row = spark.createDataFrame([("/a/b/q1_abs_memory.json", "0", "", " 3 ", "x")], "p string, a string, e string, c string, bad string")
    got = row.select(
        T.name_key(F.col("p")).alias("key"), T.reference_answer(F.col("a"), F.col("bad")).alias("zero"), T.reference_answer(F.col("e"), F.col("bad")).alias("other"),
        T.category_name(F.col("c")).alias("c"), T.category_name(F.col("bad")).alias("u"), T.category_name(F.lit(-2)).alias("m"), T.category_name(F.lit(9)).alias("h"), T.new_id("n_").alias("i"),
    ).first()
    assert (got.key, got.zero, got.other, got.c, got.u, got.m, got.h) == ("q1", "0", "x", "Open-domain", "Unknown", "Unknown", "Unknown")
    assert got.i.startswith("n_") and len(got.i) == 10
