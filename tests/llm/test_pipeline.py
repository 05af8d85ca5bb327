"""The pipeline's stages on small tables, each compared with a plain version on its own input."""

import random
import zlib

import pytest

import corpus_pipeline
from engram.llm import common, decontam, exact_dedup, html_extract, jaccard_join, packing, quality, sharding, substring_dedup, suffix_dedup, warc_zip
from engram.llm.queries import tokenizer_file

CLASHES = "_id _rows _key _digest _bad score held_out predicted uid block bucket run range shard size salt component dotted.name key kept n _of_id _mark_id _mark_key check slot points beside text_key a b other open pages".split()
KIND = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHES)
BENCH = [(1, " ".join(f"item{i}" for i in range(24))), (2, ""), (3, None)]


def documents():
    r = random.Random(5)
    words = [f"wort{i}" for i in range(400)]
    good = [" ".join(" ".join(r.choices(words, k=9)) + "." for _ in range(r.randint(3, 12))) for _ in range(90)]
    junk = [" ".join(r.choices(["#$%", "||", "BUY", "<<>>", "!!!"], k=40)) for _ in range(30)]
    near = [t + " one more" for t in sorted(good, key=len)[-5:]]
    leaked = [good[3] + " " + BENCH[0][1] + " " + good[4], good[5] + " " + BENCH[0][1].replace("item7", "other")]
    texts = good + junk + near + leaked + good[:4] + [good[8].replace(" ", "\n")] + ["", None, good[9] * 30]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9, good[9])]  # a repeated row
    labels = [(i, int(i < 90)) for i in range(120)]
    return [(i, t, "en", None, len(t or ""), *range(len(CLASHES))) for i, t in rows], labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs, labels = documents()
    spark.createDataFrame(docs, KIND).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def plain(name, docs):
    """What a stage keeps of (doc_id, text) rows."""
    if name == "exact dedup":
        best = {}
        for i, t in docs:
            key = "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
            best[key] = min(best.get(key, (0, i, t)), (-len(t or ""), i, t), key=lambda x: x[:2])
        return sorted(i for _, i, _ in best.values())
    if name == "n-gram Jaccard join":
        sets, label = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}
        for _ in range(4):
            for i, a in sets.items():
                for j, b in sets.items():
                    if a and b and 100 * len(a & b) >= 75 * len(a | b):
                        label[i] = label[j] = min(label[i], label[j])
        return sorted(i for i in sets if label[i] == i)
    return sorted(i for i, t in docs if "item20" not in (t or ""))


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, [(r.doc_id, r.text) for r in docs.collect()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, folder)
        assert out.columns == columns
        rows = out.collect()
        assert all(tuple(r)[5:] == tuple(range(len(CLASHES))) for r in rows)
        after = [(r.doc_id, r.text) for r in rows]
        if name == "quality classifier":
            kept = [i for i, _ in after]
            assert {i for i in kept if i < 90} == set(range(90)) and not {i for i in kept if 90 <= i < 120}
        else:
            assert sorted(i for i, _ in after) == plain(name, before), name
        docs, before = spark.createDataFrame(rows, out.schema), after
    total = {r.doc_id: r.doc_tokens for r in corpus_pipeline.packed(spark, docs, folder).collect()}
    assert set(total) == {i for i, _ in before}
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()) == sorted(total)


def test_stages_on_empty_table(spark, folder):
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, spark.createDataFrame([], KIND), folder).count() == 0


def test_held_out_accuracy(spark, folder):
    docs, labels = documents()
    got = quality.score(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    held = [r.predicted == dict(labels)[r.doc_id] for r in got if r.held_out and r.doc_id in dict(labels)]
    assert held and sum(held) / len(held) >= 0.95


def test_trees_without_labels(spark):
    docs = spark.createDataFrame([(None, None), (1, "a b"), (1, "a b")], "doc_id long, text string")
    got = quality.score(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert [r.score for r in got] == [0.5, 0.5, 0.5]


def test_clashing_columns(spark, folder):
    docs, n = spark.read.parquet(f"{folder}/documents.parquet"), len(documents()[0])
    labels, bench = spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    for f in (exact_dedup.exact_dedup, substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, jaccard_join.jaccard_components, sharding.shard):
        assert f(docs).count() == n
    assert quality.score(docs, labels).count() == n
    assert decontam.contaminated(docs, bench).count() == 2
    assert packing.pack(docs, tokenizer_file()).select("doc_id").distinct().count() == n - 1
    pages = docs.selectExpr("*", "doc_id AS page_id", "lang AS url", "text AS html", "1 AS host", "2 AS chunk", "3 AS digest", "4 AS refers_to")
    assert html_extract.extract(pages).count() == n
    assert warc_zip.round_trip(pages).count() == n
    assert warc_zip.round_trip(pages.limit(0)).count() == 0


def test_stages_on_nulls_and_repeats(spark, folder):
    """Rows without an identifier, or that share one, are judged one by one; of repeated rows one stays."""
    good = " ".join(f"word{i}" for i in range(40)) + "."
    leak = "start " + BENCH[0][1]
    rows = [(None, good), (None, leak), (5, good + " x"), (5, leak), (7, good), (7, good), (None, None), (None, ""), (8, "other words entirely, six of them")]
    docs = spark.createDataFrame([(i, t, "en", None, 0, *range(len(CLASHES))) for i, t in rows], KIND).repartition(3)
    seen = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    order = lambda x: sorted(x, key=str)
    clean = [x for x in rows if x[1] != leak]
    assert seen(decontam.drop_contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))) == order(clean)
    exact = seen(exact_dedup.drop_copies(docs))  # of the leaks and of the equal texts the row with the smaller doc_id stays
    assert [x for x in exact if x[1]] == order([(5, leak), (5, good + " x"), (7, good), (8, rows[8][1])]) and len(exact) == 5
    near = seen(jaccard_join.drop_near_copies(docs))
    assert [x for x in near if x[1]] == order([(5, leak), (5, good + " x"), (8, rows[8][1])])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert seen(quality.keep_good(docs, labels)) == order(rows)  # without labels all score 0.5
    total = sum(r.length for r in packing.pack(docs, tokenizer_file()).collect())
    assert total == sum(len(tokens) // 4 + 1 for tokens in packing.TokenBytes(tokenizer_file())([t or "" for _, t in rows]))


def test_many_marks_are_not_broadcast(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    keep = lambda: sorted(r.doc_id for r in jaccard_join.drop_near_copies(docs).collect())
    want = keep()
    monkeypatch.setattr(common, "BROADCAST_MARKS", -1)
    assert keep() == want and len(want) == len(set(want))
