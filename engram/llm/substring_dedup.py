"""Substring dedup over words by a log-structured fingerprint index.

The index is a set of immutable sorted runs of window fingerprints, cut into buckets by
leading bits. A batch of documents becomes a new run; runs of one level are compacted into
one of the next as soon as there are ``fan_in`` of them; and the fingerprints of blocks of
documents are merge-joined with all runs, which tell those that more than one block has.

The query adds its table batch by batch. What goes into its index are the fingerprints that
windows select as their anchors (see blocks.Anchors): a window whose anchor occurs once has
no equal. The windows with repeated anchors are then verified by 128 bits, two hashes of
different bases, and every word covered by a window that also starts elsewhere goes.
``IncrementalDedup`` holds all windows of its history by 128 bits and judges each new batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from .common import covered, free_shuffles, new_path, stage, windows, word_hashes

WINDOW, GRAM = 35, 8
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
#: The rows of a run: a bucket's fingerprints as packed_run has them, and their number.
LEVEL = "bucket int, n long, data binary"


def read(payload: bytes):
    """Identifiers, words by document, word hashes of the block, words per document."""
    ids, texts = B.unpack_docs(payload)
    words = [t.split() for t in texts]
    return ids, words, word_hashes([w for d in words for w in d]), [len(d) for d in words]


class Windows:
    """The windows of a block whose anchor repeats, and their distinct 128-bit fingerprints."""

    def __init__(self, hashes: np.ndarray, sizes: list[int], flags: np.ndarray | None, anchors: B.Anchors):
        hot = anchors.local | flags if flags is not None else np.ones(len(anchors.keys), bool)
        self.starts = anchors.starts[hot[anchors.key_of[anchors.which]]] if len(anchors.starts) else anchors.starts
        a = windows(hashes, WINDOW, 0)[self.starts] if len(self.starts) else np.empty(0, np.uint64)
        b = windows(hashes, WINDOW, 1)[self.starts] if len(self.starts) else a
        order = np.lexsort((b, a))
        sa, sb = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
        self.keys, self.second = sa[new], sb[new]
        which = np.cumsum(new) - 1
        self.key_of = np.empty(len(a), np.int64)
        self.key_of[order] = which
        self.local = np.bincount(which, minlength=len(self.keys)) > 1 if len(a) else np.empty(0, bool)


def _widths(n_bytes: int) -> tuple[int, int]:
    """Buckets for anchors and for windows, from the bytes of the corpus."""
    return B.bucket_count(n_bytes // 70), B.bucket_count(n_bytes // 15)


def _kept(ids, words: list[list[bytes]], gone: np.ndarray, with_text: bool) -> pa.Table:
    """A block's result rows, from the mask of its words that go."""
    rows, at = [], 0
    for doc_id, d in zip(ids, words, strict=True):
        mask = gone[at : at + len(d)]
        at += len(d)
        n = int(mask.sum())
        kept = b" ".join(compress(d, (~mask).tolist()) if n else d)
        rows.append((doc_id, len(d), n, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
    columns = list(zip(*rows, strict=True))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + with_text]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=False)})


def substring_dedup(docs: DataFrame, with_text: bool = True, block_bytes: int = B.BLOCK_BYTES, batches: int = 4, fan_in: int = 4) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (, kept_text).

    The table goes into the index in ``batches``. Words are runs of bytes outside ASCII white space, unchanged; null text has none. A text
    of fewer words than a window loses nothing. Windows are judged on the input. Repeated rows
    are different documents with equal words, so their windows repeat; a null doc_id stays
    null. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    held = B.make_blocks(docs, block_bytes)
    n_anchor, n_window = _widths(B.total_bytes(held))
    l_anchor, l_window = B.lanes(n_anchor), B.lanes(n_window)
    index = FingerprintIndex(spark, n_anchor, fan_in)

    def name(block: int, payload: bytes) -> pa.Table:
        *_, hashes, sizes = read(payload)
        return B.run_table(B.runs_of(B.Anchors(hashes, sizes, WINDOW, GRAM).keys, block, l_anchor))

    added = pieces = None
    for batch in batches_of(held, batches):
        runs, mine = _batch_runs(B.per_block(batch, name, B.RUN), held, n_anchor)
        index.add(runs)
        added = runs if added is None else added.unionByName(runs)
        pieces = mine if pieces is None else pieces.unionByName(mine)
    index.compact()
    anchors = stage(_judged(index, added, pieces, n_anchor), "anchors")
    free_shuffles(spark)

    def send(block: int, payload: bytes, answers: pa.Table) -> pa.Table:
        *_, hashes, sizes = read(payload)
        found = B.Anchors(hashes, sizes, WINDOW, GRAM)
        w = Windows(hashes, sizes, B.flags_of(answers, found.keys, l_anchor), found)
        return B.run_table(B.runs_of(w.keys, block, l_window, w.second))

    judged = stage(B.exchange(B.with_answers(held, anchors, send, B.RUN), held, [n_window]), "windows")
    free_shuffles(spark)
    # both sets of answers travel together; those on anchors come with negative buckets
    both = judged.unionByName(anchors.withColumn("bucket", -1 - F.col("bucket")))

    def remove(block: int, payload: bytes, answers: pa.Table) -> pa.Table:
        ids, words, hashes, sizes = read(payload)
        found = B.Anchors(hashes, sizes, WINDOW, GRAM)
        bucket = answers.column("bucket").to_numpy()
        on_anchors = answers.filter(pa.array(bucket < 0))
        on_anchors = on_anchors.set_column(1, "bucket", pa.array(-1 - bucket[bucket < 0], pa.int32()))
        w = Windows(hashes, sizes, B.flags_of(on_anchors, found.keys, l_anchor), found)
        again = w.local | B.flags_of(answers.filter(pa.array(bucket >= 0)), w.keys, l_window)
        gone = covered(w.starts[again[w.key_of]], WINDOW, len(hashes))
        return _kept(ids, words, gone, with_text)

    return B.with_answers(held, both, remove, RESULT + ", kept_text string" * with_text)


def _batch_runs(runs: DataFrame, held: DataFrame, n_buckets: int) -> tuple[DataFrame, DataFrame | None]:
    """The staged runs of a batch in the index's buckets: those of its blocks, or of the pieces where blocks send to lanes."""
    if B.lanes(n_buckets) == n_buckets:
        return stage(runs, "batch"), None
    pieces = B.gathered(runs, held, B.lanes(n_buckets))
    return stage(B.piece_runs(pieces, [n_buckets]), "batch"), pieces


def _judged(index: FingerprintIndex, runs: DataFrame, pieces: DataFrame | None, n_buckets: int) -> DataFrame:
    """The index's answers to the blocks whose fingerprints were added as these runs."""
    answers = index.judge(runs)
    return answers if pieces is None else B.spread(pieces, answers, [n_buckets], with_late=False)


def batches_of(held: DataFrame, batches: int) -> list[DataFrame]:
    """Blocks by the task that made them, which Parquet's statistics tell apart, so that a batch reads its own files."""
    last = held.agg(F.max("block")).first()[0]
    n = 1 if last is None else (last >> 33) + 1
    edges = sorted({n * k // batches for k in range(batches + 1)})
    return [held.where((F.col("block") >= a << 33) & (F.col("block") < b << 33)) for a, b in zip(edges, edges[1:], strict=False)]


def packed_run(keys: np.ndarray, second: np.ndarray | None, many: np.ndarray) -> bytes:
    """Sorted fingerprints of 64 or 128 bits, with a bit for those that more than one block has."""
    return B.pack_sorted(keys) + (b"" if second is None else second.astype("<u8").tobytes()) + np.packbits(many).tobytes()


def unpacked_run(data: bytes, wide: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    keys, at = B.unpack_sorted(data), B.packed_size(data)
    n = len(keys)
    second = np.frombuffer(data, "<u8", n, at) if wide else None
    many = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at + 8 * n * wide), count=n).astype(bool)
    return keys, second, many


def merged(parts: list[tuple[np.ndarray, np.ndarray | None, np.ndarray]]) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """One sorted run of several: a fingerprint in two of them is in more than one block."""
    keys, many = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
    second = None if parts[0][1] is None else np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable") if second is None else np.lexsort((second, keys))
    keys, many = keys[order], many[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    if second is not None:
        second = second[order]
        new[1:] |= second[1:] != second[:-1]
    first = np.flatnonzero(new)
    held = np.diff(np.append(first, len(keys)))
    return keys[first], None if second is None else second[first], (np.maximum.reduceat(many, first) if len(first) else many) | (held > 1)


def many_of(index: tuple, keys: np.ndarray, second: np.ndarray | None) -> np.ndarray:
    """Whether the index, which holds these sorted fingerprints, knows each from more than one block."""
    held, other, many = index
    at = np.searchsorted(held, keys, "left")
    while second is not None:  # fingerprints that agree in 64 bits only stand next to each other
        wrong = other[at] != second
        if not wrong.any():
            break
        at[wrong] += 1
    return many[at]


class FingerprintIndex:
    """A log-structured set of fingerprints of 64 bits, or of 128 (wide).

    A run lies in a folder of its own, written once; names are never used again. Every change
    ends with a new manifest, so an index is reopened as its last one lists it, and the files of a change
    that was cut short are never read. The number of buckets is a parameter (a power of two beyond blocks.FAN); ``grow`` doubles it
    before a batch that would fill buckets beyond ``per_bucket`` fingerprints, and runs with
    fewer buckets are cut when they are read.
    """

    def __init__(self, spark: SparkSession, n_buckets: int = 16, fan_in: int = 4, wide: bool = False, folder: str | None = None, per_bucket: int = 3_000_000):
        self.spark, self.n_buckets, self.fan_in, self.wide, self.per_bucket = spark, B.whole(n_buckets), fan_in, wide, per_bucket
        self.folder = folder or new_path(spark, "index")
        self.runs: list[tuple[int, int, int, str]] = []  # level, buckets, fingerprints, path
        self.written = 0

    @classmethod
    def reopen(cls, spark: SparkSession, folder: str, **options) -> FingerprintIndex:
        out = cls(spark, folder=folder, **options)
        last = spark.read.parquet(f"{folder}/manifest-*").orderBy(F.desc("written")).first()
        out.written, out.n_buckets, out.wide = last["written"], B.whole(last["n_buckets"]), last["wide"]
        out.runs = [tuple(r) for r in last["runs"]]
        return out

    def _commit(self) -> None:
        self.written += 1
        row = [(self.written, self.n_buckets, self.wide, self.runs)]
        schema = "written long, n_buckets int, wide boolean, runs array<struct<level: int, n_buckets: int, n: long, path: string>>"
        self.spark.createDataFrame(row, schema).coalesce(1).write.parquet(f"{self.folder}/manifest-{self.written:06d}")

    def _write(self, rows: DataFrame, level: int) -> None:
        self.written += 1
        path = f"{self.folder}/run-{self.written:06d}"
        rows.write.parquet(path)
        n = self.spark.read.schema(LEVEL).parquet(path).agg(F.sum("n")).first()[0] or 0
        self.runs.append((level, self.n_buckets, n, path))

    def _read(self, runs: list) -> DataFrame:
        """The rows of the runs, in today's buckets."""
        wide, n_buckets, out = self.wide, self.n_buckets, self.spark.createDataFrame([], LEVEL)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column(2).to_pylist():
                    keys, second, many = unpacked_run(data, wide)
                    buckets, edges = B.cuts(keys, n_buckets)
                    rows = []
                    for k, i in enumerate(buckets.tolist()):
                        part = slice(edges[k], edges[k + 1])
                        rows.append({"bucket": i, "n": int(edges[k + 1] - edges[k]), "data": packed_run(keys[part], second[part] if wide else None, many[part])})
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("data", pa.binary())]))

        for _, n, _, path in runs:
            rows = self.spark.read.schema(LEVEL).parquet(path)
            out = out.unionByName(rows if n == n_buckets else rows.mapInArrow(cut, LEVEL))
        return out

    def grow(self, n_new: int) -> None:
        """Room for that many new fingerprints, before their runs are made with ``n_buckets``."""
        while sum(r[2] for r in self.runs) + n_new > self.per_bucket * self.n_buckets:
            self.n_buckets = B.whole(2 * self.n_buckets)

    def add(self, batch: DataFrame) -> None:
        """Adds the fingerprints of a batch, given as the runs (bucket, block, data) of its blocks; every block once."""
        wide = self.wide

        def one(table: pa.Table) -> pa.Table:
            parts = []
            for data in table.column("data").to_pylist():
                keys = B.unpack_sorted(data)
                parts.append((keys, np.frombuffer(data, "<u8", len(keys), B.packed_size(data)) if wide else None, np.zeros(len(keys), bool)))
            run = merged(parts)
            return _level_row(table.column("bucket")[0].as_py(), run)

        self._write(batch.groupBy("bucket").applyInArrow(one, LEVEL), 0)
        level = 0
        while len(full := [r for r in self.runs if r[0] == level]) >= self.fan_in:
            self._merge(full, level + 1)
            level += 1
        self._commit()

    def compact(self) -> None:
        """Merges all runs into one."""
        if len(self.runs) > 1:
            self._merge(self.runs, max(r[0] for r in self.runs))
            self._commit()

    def _merge(self, runs: list, level: int) -> None:
        wide = self.wide

        def one(table: pa.Table) -> pa.Table:
            return _level_row(table.column("bucket")[0].as_py(), merged([unpacked_run(d, wide) for d in table.column("data").to_pylist()]))

        rows = self._read(runs).groupBy("bucket").applyInArrow(one, LEVEL)
        self.runs = [r for r in self.runs if r not in runs]
        self._write(rows, level)

    def judge(self, blocks: DataFrame) -> DataFrame:
        """Answers the runs of blocks that were added with a bit per fingerprint: whether more than one block has it."""
        wide = self.wide

        def one(table: pa.Table, history: pa.Table) -> pa.Table:
            index = merged([unpacked_run(d, wide) for d in history.column("data").to_pylist()])
            out = []
            for data in table.column("data").to_pylist():
                keys = B.unpack_sorted(data)
                second = np.frombuffer(data, "<u8", len(keys), B.packed_size(data)) if wide else None
                out.append(np.packbits(many_of(index, keys, second)).tobytes())
            return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "flags": pa.array(out, pa.binary())}) if out else _NO_ANSWER

        history = self._read(self.runs)
        return blocks.groupBy("bucket").cogroup(history.groupBy("bucket")).applyInArrow(one, B.ANSWER)


_NO_ANSWER = pa.table({"block": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "flags": pa.array([], pa.binary())})


def _level_row(bucket: int, run: tuple) -> pa.Table:
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "n": pa.array([len(run[0])], pa.int64()), "data": pa.array([packed_run(*run)], pa.binary())})


class IncrementalDedup:
    """Dedup of batches against all batches before them; the index has every window by 128 bits.

    ``add`` returns one row per document of the batch: doc_id, n_words, n_removed (words covered
    by a window that the history or the batch itself also has), kept_sha256 (, kept_text).
    Documents of earlier batches are not judged again. Nulls, empty texts and repeated rows are
    treated as by ``substring_dedup``; an empty batch gives an empty result. A later session goes
    on with the reopened index.
    """

    def __init__(self, index: FingerprintIndex):
        self.index = index

    def add(self, batch: DataFrame, with_text: bool = False, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
        held, index = B.make_blocks(batch, block_bytes), self.index
        index.grow(B.total_bytes(held) // 6)  # words, about
        n_buckets = index.n_buckets
        n_lanes = B.lanes(n_buckets)

        def every(payload: bytes):
            ids, words, hashes, sizes = read(payload)
            return ids, words, hashes, Windows(hashes, sizes, None, B.Anchors(hashes, sizes, WINDOW, GRAM))

        def send(block: int, payload: bytes) -> pa.Table:
            w = every(payload)[3]
            return B.run_table(B.runs_of(w.keys, block, n_lanes, w.second))

        runs, pieces = _batch_runs(B.per_block(held, send, B.RUN), held, n_buckets)
        index.add(runs)

        def remove(block: int, payload: bytes, answers: pa.Table) -> pa.Table:
            ids, words, hashes, w = every(payload)
            again = w.local | B.flags_of(answers, w.keys, n_lanes)
            return _kept(ids, words, covered(w.starts[again[w.key_of]], WINDOW, len(hashes)), with_text)

        answers = stage(_judged(index, runs, pieces, n_buckets), "answers")
        return stage(B.with_answers(held, answers, remove, RESULT + ", kept_text string" * with_text), "batch-result")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM d),
s AS (
  SELECT *, CASE WHEN i + 35 <= n THEN md5(string_agg(word, ' ') OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS win FROM p),
r AS (SELECT *, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS again FROM s),
c AS (
  SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM r),
k AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
