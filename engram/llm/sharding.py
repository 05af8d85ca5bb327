"""Sharding by sampled splitters.

Records are ordered by (hash of the text, doc_id), so equal texts stand together. A
size-weighted sample of keys gives quantile boundaries, as many as the number of rows asks
for; records are dealt into the ranges between them; ranges that turn out overfull are
subdivided by a second sample of their own keys. A boundary stands behind all copies of a
text, unless the copies alone fill a range and are divided by identifier. Exact byte counts
of the ranges then turn each record's running sum inside its range into a global position,
and the position decides the shard: of copies that fill at most a sixteenth of a shard the
position of their middle, so that they stay together, of others each its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_text, stage

OVERHEAD = 16
#: Copies of a text up to this part of a shard's share are never divided.
WHOLE = 16
_LAST = (1 << 63) - 1


def _drawn(keys: DataFrame, chance) -> list:
    """The sampled keys with a range; a row is drawn by a hash, so that it is the same after a task is run again."""
    draw = F.pmod(F.xxhash64("text_key", "id_key", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return keys.where(draw < chance).select("range", "text_key", "id_key", "size").collect()


def quantiles(rows: list[tuple[int, int, float]], want: int) -> list[tuple[int, int]]:
    """At most want - 1 boundaries of sorted (text_key, id_key, weight). A text that fills a range is divided by identifier."""
    share, of_text, out, done = sum(r[2] for r in rows) / want, {}, [], 0.0
    for text_key, _, w in rows:
        of_text[text_key] = of_text.get(text_key, 0.0) + w
    for text_key, id_key, w in rows:
        done += w
        if done >= share * (len(out) + 1) and len(out) < want - 1:
            out.append((text_key, id_key if of_text[text_key] >= share else _LAST))
    return sorted(set(out))


def ranged(keys: DataFrame, points: list[tuple[int, int]]) -> DataFrame:
    """The rows with the index of their range: the number of points below (text_key, id_key).

    Points are looked up by the leading bits of text_key in a broadcast table, whose size is
    bounded by the number of points, and by a binary search among those of equal bits.
    """
    bits = min(16, max(1, len(points)).bit_length())
    table: list[list] = [[i, 0, []] for i in range(1 << bits)]
    for text_key, id_key in points:
        table[(text_key >> (64 - bits)) + (1 << bits - 1)][2].append((text_key, id_key))
    for before, row in zip(table, table[1:], strict=False):
        row[1] = before[1] + len(before[2])
    steps = max(len(r[2]) for r in table).bit_length()
    lookup = keys.sparkSession.createDataFrame(table, "slot int, first int, points array<struct<t: bigint, i: bigint>>")
    key = F.struct(F.col("text_key").alias("t"), F.col("id_key").alias("i"))

    def halve(s, _):
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = (s["lo"] < s["hi"]) & (F.get("points", middle) < key)
        return F.struct(F.when(below, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(F.least(s["hi"], middle)).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size("points").alias("hi"))
    place = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["lo"] if steps else F.lit(0)
    slot = (F.shiftright("text_key", 64 - bits) + F.lit(1 << bits - 1)).cast("int")
    return keys.withColumn("slot", slot).join(F.broadcast(lookup), "slot").withColumn("range", F.col("first") + place).drop("slot", "first", "points")


def shard(docs: DataFrame, n_shards: int = 40, rows_per_range: int = 1_000_000, oversample: int = 64, overfull: float = 2.0) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``. Size: UTF-8 bytes of the text (null: none) plus 16. Ties of equal texts are
    broken by doc_id, a null doc_id counting as the smallest; repeated rows get slots of their
    own. Equal texts share a shard as long as they fill at most a sixteenth of one; larger
    groups are divided, as sizes come first. A text longer than a shard's share fills its shard
    alone and the shards it overlaps may stay empty. An empty table gives an empty result;
    other columns are ignored.
    """
    spark, text = docs.sparkSession, doc_text()
    keys = stage(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("text_key"),
            F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("id_key"),
        ),
        "keys",
    )
    n, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_ranges = max(64, -(-n // rows_per_range))
    oversample = max(8, min(oversample, 500_000 // n_ranges))

    def weighed(rows: list, aim: float, of: int) -> list[tuple[int, int, float]]:
        return sorted((r[1], r[2], max(1.0, r[3] * aim / max(of, 1))) for r in rows)

    aim = n_ranges * oversample
    first = _drawn(keys.withColumn("range", F.lit(0)), F.col("size") * F.lit(aim / max(total, 1)))
    points = quantiles(weighed(first, aim, total), n_ranges)
    sizes = {r[0]: r[1] for r in ranged(keys, points).groupBy("range").agg(F.sum("size")).collect()}
    most = overfull * total / n_ranges
    wants = {i: max(2, round(2 * size / most)) for i, size in sizes.items() if size > most}  # at most n_ranges / overfull of them
    if wants:
        chances = spark.createDataFrame([(i, w * oversample / sizes[i]) for i, w in wants.items()], "range int, rate double")
        inside: dict[int, list] = {}
        for r in _drawn(ranged(keys, points).join(F.broadcast(chances), "range"), F.col("size") * F.col("rate")):
            inside.setdefault(r[0], []).append(r)
        for i, rows in inside.items():
            points += quantiles(weighed(rows, wants[i] * oversample, sizes[i]), wants[i])
        points = sorted(set(points))
    dealt = ranged(keys, points)
    before, done = {}, 0
    for r in sorted(dealt.groupBy("range").agg(F.sum("size")).collect()):
        before[r[0]] = done
        done += r[1]
    starts = spark.createDataFrame(sorted(before.items()), "range int, before long")
    order = Window.partitionBy("range").orderBy("text_key", "id_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("range", "text_key")
    placed = dealt.join(F.broadcast(starts), "range").withColumns({  # one row per range: bounded by the number of ranges
        "upto": F.col("before") + F.sum("size").over(order), "row": F.row_number().over(order),
    })
    placed = placed.withColumns({"of_group": F.sum("size").over(group), "end_of_group": F.max("upto").over(group)})
    placed = stage(placed.drop("before"), "placed")
    divided = sorted({t for t, i in points if i != _LAST})  # texts whose copies lie in several ranges: no more than points
    if divided:
        of_text = placed.join(F.broadcast(spark.createDataFrame([(t,) for t in divided], "text_key long")), "text_key").groupBy("text_key")
        found = of_text.agg(F.sum("size").alias("of_text"), F.max("upto").alias("end_of_text")).collect()
        known = spark.createDataFrame([tuple(r) for r in found], "text_key long, of_text long, end_of_text long")
        placed = placed.join(F.broadcast(known), "text_key", "left").withColumns({"of_group": F.coalesce("of_text", "of_group"), "end_of_group": F.coalesce("end_of_text", "end_of_group")})
    whole = F.col("of_group") <= F.lit(total // (n_shards * WHOLE))
    twice = F.when(whole, F.col("end_of_group") * 2 - F.col("of_group")).otherwise(F.col("upto") * 2 - F.col("size"))  # twice the middle
    placed = placed.withColumn("twice", twice).withColumn("shard", F.expr(f"CAST((twice * {n_shards}L) div {max(1, 2 * total)}L AS INT)"))
    counts: dict[tuple[int, int], int] = {}
    done = {}
    for r in sorted(placed.groupBy("range", "shard").agg(F.count("*"), F.min("row")).collect()):
        counts[r[0], r[1]] = done.get(r[1], 0) - r[3]  # slot = row + (rows of the shard in earlier ranges) - first row
        done[r[1]] = done.get(r[1], 0) + r[2]
    shifts = spark.createDataFrame([(*k, v) for k, v in sorted(counts.items())], "range int, shard int, shift long")
    return placed.join(F.broadcast(shifts), ["range", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") + F.col("shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
