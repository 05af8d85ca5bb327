"""Exact dedup by a tree-merge of sorted digest runs (DataFrame functions only).

Every document is put into one of ``n_runs`` runs by a hash of its identifier and text. A run is
the digests of its documents, sorted, one row for each digest with the best document and
the number of copies. Runs then meet in binomial rounds: in round r the runs whose number
agrees after dropping ``log2(fan_in)`` low bits are merged, keeping for each digest the
best identifier. Aggregating a struct makes Spark sort by (run, digest) and fold equal
neighbours, which is the multiway merge. The winners go back down the same tree, so no
key ever has more rows than ``fan_in`` or than the copies inside one run: a group that
holds a third of the corpus never meets in a single task.

Rows with equal digests are verified by a second digest of another family over the same
text: both are part of the merge key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, doc_text, settle, stage


def normalised(text: Column) -> Column:
    """The text without the six ASCII white space characters."""
    return F.translate(text, WHITESPACE, "")


def run_count(n_rows: int, rows_per_run: int, fan_in: int) -> int:
    """A power of the fan-in, so that the tree is regular."""
    need = max(1, math.ceil(n_rows / rows_per_run))
    levels = max(1, math.ceil(math.log(need, fan_in) - 1e-9)) if need > 1 else 1
    return fan_in**levels


def exact_dedup(docs: DataFrame, rows_per_run: int = 4096, fan_in: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Equal: identical after deleting ASCII white space; null text counts as empty. The row
    with the most code points in its original text stays, then the smallest doc_id (a null
    doc_id counts as the largest). Repeated rows (same doc_id, same text) stay or go
    together as copies of one another: all carry the group's keep_id, and ``kept`` is true
    for each of them whose doc_id is keep_id. An empty table gives an empty result; other
    columns are ignored.
    """
    return _judged(docs, rows_per_run, fan_in).drop("check")


def _judged(docs: DataFrame, rows_per_run: int = 4096, fan_in: int = 16) -> DataFrame:
    """The rows of ``exact_dedup`` with the second digest of the normalised text."""
    norm = normalised(doc_text())
    digests = stage(
        docs.select(
            "doc_id",
            F.length(doc_text()).alias("n_code_points"),
            F.unhex(F.sha2(norm, 256)).alias("digest"),
            F.xxhash64(norm).alias("check"),
        ),
        "digests",
    )
    n_runs = run_count(digests.count(), rows_per_run, fan_in)
    # The best row has the smallest (negated length, id is null, id).
    rank = F.struct((-F.col("n_code_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"))
    key = ["digest", "check"]
    digests = digests.withColumn("run", F.pmod(F.xxhash64("doc_id", "check"), F.lit(n_runs)).cast("int"))
    levels, runs = [digests.groupBy("run", *key).agg(F.min(rank).alias("best"), F.count("*").alias("n"))], n_runs
    while runs > 1:
        runs //= fan_in
        levels.append(
            levels[-1].withColumn("run", F.expr(f"run div {fan_in}").cast("int"))
            .groupBy("run", *key)
            .agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        )
    # The winners of groups of two or more. Spark walks the way up once: its exchanges are reused on the way down.
    top = levels.pop().where("n > 1").select("run", *key, F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"))
    while levels:  # back down: each run learns its groups' winners from the run it was merged into
        lower = levels.pop().select(F.col("run").alias("child"), F.expr(f"run div {fan_in}").cast("int").alias("run"), *key)
        top = lower.join(top, ["run", *key]).select(F.col("child").alias("run"), *key, "keep_id", "group_size")
    out = digests.join(top.withColumn("grouped", F.lit(True)), ["run", *key], "left")
    keep = F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "check",
    )


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with all their columns; of repeated rows one stays.

    Nulls are treated as by ``exact_dedup``; rows that share a doc_id but not a text are judged apart.
    """
    flags = _judged(docs.select("doc_id", "text"), **options)
    marks = flags.groupBy("doc_id", F.col("check").alias("key")).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    return settle(docs, marks.where("NOT kept OR n > 1"), F.xxhash64(normalised(doc_text())))


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY length(t) DESC, doc_id)
"""
