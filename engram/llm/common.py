"""Helpers shared by the training-data operators.

Word rule of the contracts: words are maximal runs of bytes outside
``[\\x20\\x09-\\x0D]``; ``bytes.split()`` splits on exactly that class.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space deleted or split on by the contracts.
WHITESPACE = " \t\n\x0b\x0c\r"
_own_dirs: dict[str, str] = {}
_cleaned: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a temporary one where all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _own_dirs.setdefault(app, "file://" + tempfile.mkdtemp(prefix="engram-"))
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's part of the shared folder, which is deleted when the driver's JVM ends."""
    top = f"{scratch_dir(spark)}/engram/{spark.sparkContext.applicationId}"
    if top not in _cleaned:
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _cleaned.add(top)
    return f"{top}/{uuid.uuid4().hex}-{label}"


#: Rows in a file of a staged table whose number of rows is known.
ROWS_PER_FILE = 500_000


def stage(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage, so a lost executor costs a reread and not a recomputation. A bound on
    its rows keeps a small table from being written as a file for each partition.
    """
    path = new_path(df.sparkSession, label)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give a worker's freed memory back, which it would otherwise hold between tasks; without effect where that can't be asked for."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it while a column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(df: DataFrame) -> list:
    """All columns of ``df``, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def doc_text(text: str = "text"):
    """Null text counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def beside(df: DataFrame, key: str) -> DataFrame:
    """The rows with a second join key made of the first.

    A join by both keys shuffles its sides on its own account, also one that was just grouped by
    the first key; only then can Spark split the rows of a hot key over tasks.
    """
    return df.withColumn("beside", F.pmod(F.hash(key), F.lit(7)))


def shuffled(df: DataFrame) -> DataFrame:
    """The rows as one side of a join that is never broadcast.

    Spark broadcasts a staged table by the size of its compressed files, and the driver builds it
    some twenty times as large; several such tables at once, each growing with the corpus, fill it.
    """
    return df.hint("merge")


def text_key(text: str = "text"):
    """64 bits of a text, which tell rows of one doc_id apart; null text counts as empty."""
    return F.xxhash64(doc_text(text))


#: Most marks that are broadcast: 17 bytes each, some 25 MB in the table of a join.
BROADCAST_MARKS = 250_000


def settle(docs: DataFrame, marks: DataFrame, key) -> DataFrame:
    """The documents with all their columns, but for those that are marked.

    marks: (doc_id, key, kept), distinct by (doc_id, key). A document with a mark goes; of those
    that share a mark with ``kept``, one stays. Documents without a mark are neither shuffled
    nor grouped while the marks are few enough to be broadcast; beyond that they are joined by
    (doc_id, key), so rows without a doc_id are dealt by their texts.
    """
    own, key_name = unused(docs, "_mark_id"), unused(docs, "_mark_key")
    marks = stage(marks.select(F.col("doc_id").alias("_of_id"), F.col("key").alias("_of_key"), "kept"), "marks")
    n, repeats = marks.agg(F.count("*"), F.count(F.when(F.col("kept"), 1))).first()
    keyed = docs.withColumns({own: F.col("doc_id"), key_name: key})

    def meet(m: DataFrame, how: str) -> DataFrame:
        m = m.select("_of_id", "_of_key")
        on = keyed[own].eqNullSafe(m["_of_id"]) & (keyed[key_name] == m["_of_key"])
        return keyed.join(F.broadcast(m) if n <= BROADCAST_MARKS else m, on, how)

    if not n:
        return docs
    out = meet(marks, "left_anti")
    if repeats:
        out = out.unionByName(meet(marks.where("kept"), "left_semi").dropDuplicates([own, key_name]))
    return out.select(*quoted(docs))


# --- vectorised hashing -------------------------------------------------------

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least n of each."""
    got = _powers.get(which)
    if got is None or len(got[0]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        base = _BASES[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            out.append(np.cumprod(t))
        _powers[which] = got = (out[0], out[1])
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Windows are hashed so many at a time, so that the tables of powers stay small.
STRETCH = 1 << 15


def windows(h: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of every run of ``width`` consecutive elements of ``h`` (unsigned 64-bit), wherever the run stands."""
    n = len(h) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    power, inverse = _power_tables(which, min(n, STRETCH) + width)
    for at in range(0, n, STRETCH):
        piece = h[at : at + STRETCH + width - 1]
        prefix = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * power[: len(piece)], out=prefix[1:])
        k = len(piece) + 1 - width
        out[at : at + k] = mix((prefix[width:] - prefix[:-width]) * inverse[:k])
    return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask over n elements of those inside [s, s + width) for some start s."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + width, n), minlength=n + 1)
    return np.cumsum(edge[:n]) > 0
