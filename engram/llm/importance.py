"""Target-distribution importance resampling over a position table of n-grams.

Words are exploded with their positions; window lead() puts the following words of the same
document beside each, and every order's n-gram is hashed into a bucket. Buckets of all
documents and of all target texts are counted, their log-ratios are the gains, and a
document's weight is the sum of the gains that its n-grams join. Gumbel noise made of the
identifier turns weights into a sample without replacement: the highest scores are drawn.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_text, stage

#: What stands between words, before lower-casing: all of ASCII but digits and letters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a document whose positions are sorted together; a longer document is cut.
SEGMENT = 4_096


def lowered(word: Column) -> Column:
    """A to Z in lower case and nothing else; words of ASCII alone take the fast way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def words(text: str) -> Column:
    """The words of a text; a gap at either end leaves no empty one."""
    w = F.split(text, GAP)
    first, last = (F.get(w, F.lit(0)) == "").cast("int"), (F.element_at(w, -1) == "").cast("int")
    return F.slice(w, first + 1, F.greatest(F.size(w) - first - last, F.lit(0)))


def position_table(docs: DataFrame, key: str, orders: int, buckets: int, text: str = "text") -> DataFrame:
    """(uid, key, b1 .. b<orders>): for each position of each row the buckets of the n-grams that begin there, null where the text ends before.

    Rows without words have one row of nulls. A text is cut into segments, each with the words that
    its last n-grams reach over, so one long text is sorted in many parts. uid tells rows apart,
    whatever their keys; it follows the order of the rows of a partition, so ``docs`` should be
    read from files.
    """
    of = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("key"), doc_text(text).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    far = F.octet_length("text") > 2 * SEGMENT  # a word and its gap take two bytes
    of = of.withColumn("w", F.when(far, words("text")))
    begins = F.sequence(F.lit(1), F.size("w"), F.lit(SEGMENT))
    pieces = F.transform(begins, lambda i: F.array_join(F.slice("w", i, F.lit(SEGMENT + orders - 1)), " "))
    cut = of.select("uid", "key", F.posexplode(F.when(F.size("w") > 0, pieces).otherwise(F.array("text"))).alias("begin", "piece"))
    dealt = cut.repartition(n, "uid", "begin")  # texts are dealt, which are smaller than their words
    rows = dealt.select("uid", "key", "begin", F.posexplode_outer(words("piece")).alias("pos", "word")).withColumn("word", lowered(F.col("word")))
    at = Window.partitionBy("uid", "begin").orderBy("pos")
    rows = rows.withColumns({f"w{i}": F.lead("word", i).over(at) for i in range(1, orders)}).where(F.coalesce("pos", F.lit(0)) < SEGMENT)
    grams, out = F.col("word"), {"b1": bucket(F.col("word"), buckets)}
    for i in range(1, orders):
        grams = F.concat(grams, F.lit(" "), F.col(f"w{i}"))
        out[f"b{i + 1}"] = bucket(grams, buckets)
    return rows.select("uid", "key", *[c.alias(name) for name, c in out.items()])


def bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(buckets)).cast("int")


def _melted(table: DataFrame, orders: int) -> DataFrame:
    return table.withColumn("bucket", F.explode(F.array(*[f"b{i}" for i in range(1, orders + 1)]))).where("bucket IS NOT NULL")


def counts(table: DataFrame, orders: int, name: str) -> DataFrame:
    """(bucket, name): features of each bucket."""
    return _melted(table, orders).groupBy("bucket").agg(F.count("*").alias(name))


def gains(docs: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket, from the counts (bucket, s) and (bucket, t): 1000 times the log of the ratio of smoothed shares, rounded down."""
    spark = docs.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(docs, "bucket", "left").join(target, "bucket", "left").fillna(0, ["s", "t"])
    s_all, t_all = (df.agg(F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_all")) for df, c in ((docs, "s"), (target, "t")))
    both = every.crossJoin(F.broadcast(s_all)).crossJoin(F.broadcast(t_all))  # one row each
    num = lambda c, more: F.col(c).cast("double") + F.lit(float(more))
    ratio = (num("t", 1) * num("s_all", buckets)) / (num("s", 1) * num("t_all", buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise of the key, times 1000, rounded down; a null key counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
                                  .cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, share: int) -> DataFrame:
    """The rows with a rank: 1, 2, 3 .. for the highest scores of ``share`` percent of those that may be drawn, else null.

    Rows that may be drawn are ranged by score; the sizes of the ranges before a row's own, a
    number for each partition, make its place in the range its rank. Only ranges that hold
    drawn rows are sorted.
    """
    spark, order = scored.sparkSession, [F.desc("score"), F.asc_nulls_last("key"), F.asc("uid")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = stage(scored.where("drawable").repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes, before, starts = sorted(held.groupBy("part").count().collect()), 0, []
    total = sum(r[1] for r in sizes)
    most = total * share // 100
    for part, rows in sizes:
        if before < most:
            starts.append((part, before))
        before += rows
    first = spark.createDataFrame(starts, "part int, before long")
    top = held.join(F.broadcast(first), "part")  # at most a row for each partition
    top = top.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    top = top.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = held.join(F.broadcast(first), "part", "left_anti").unionByName(scored.where("NOT drawable").withColumn("part", F.lit(0)))
    return top.drop("before").unionByName(rest.withColumn("rank", F.lit(None).cast("long"))).drop("part")


def resample(docs: DataFrame, target: DataFrame, orders: int = 3, buckets: int = 10_000, least_words: int = 20, share: int = 5, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """A row for each document: key, n_words, n_features, weight, score, rank; rank is null for those that aren't drawn.

    ``target`` holds texts (text) of the wanted distribution. Null texts are empty; a document without
    words weighs 0. Rows that repeat a key are documents of their own, and rows that are equal in
    score and key take ranks one after the other. A null key's noise is that of an empty one, and
    it comes last among ties. Empty tables give empty results, an empty target only smoothed shares;
    other columns are ignored.
    """
    table = stage(position_table(docs, key, orders, buckets), "positions")
    aims = target.select(F.lit(0).alias("key"), "text")
    gain = stage(gains(counts(table, orders, "s"), counts(position_table(aims, "key", orders, buckets), orders, "t"), buckets), "gains")
    weighed = _melted(table, orders).join(F.broadcast(gain), "bucket").groupBy("uid").agg(F.count("*").alias("n_features"), F.sum("gain").alias("weight"))
    words = table.groupBy("uid").agg(F.first("key").alias("key"), F.count("b1").alias("n_words"))
    scored = words.join(weighed, "uid", "left").fillna(0, ["n_features", "weight"])
    scored = scored.withColumns({"score": F.col("weight") + noise(F.col("key"), seed), "drawable": F.col("n_words") >= least_words})
    return ranked(stage(scored, "scores"), share).select(F.col("key").alias(key), "n_words", "n_features", "weight", "score", "rank")


#: The checksum is written out, as DuckDB has none: a table of 256 entries by its rule, then a fold over the bytes.
ORACLE = r"""
WITH steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark
), split AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), grams AS (
  SELECT side, id, unnest(list_concat(w, list_concat(
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS g FROM split
), hashed AS (
  SELECT g, xor(list_reduce(list_concat([4294967295], list_transform(range(0, octet_length(encode(g))), lambda i: CAST('0x' || substr(hex(encode(g)), 2 * i + 1, 2) AS BIGINT))),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT g FROM grams), steps
), f AS (
  SELECT side, id, bucket FROM grams JOIN hashed USING (g)
), seen AS (
  SELECT b.bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM range(10000) b(bucket) LEFT JOIN f ON f.bucket = b.bucket GROUP BY 1
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * (SELECT sum(s) + 10000 FROM seen)) / (CAST(s + 1 AS DOUBLE) * (SELECT sum(t) + 10000 FROM seen)))) AS BIGINT) AS gain FROM seen
), weights AS (
  SELECT id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id
), scores AS (
  SELECT id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) AS n_words,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('42:' || id), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM split LEFT JOIN weights USING (id) WHERE side = 'd'
), places AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scores WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 5 * count(*) // 100 FROM places) THEN place END AS rank
FROM scores LEFT JOIN places USING (doc_id)
"""
