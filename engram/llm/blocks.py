"""Blocks of documents that exchange sorted fingerprint runs.

Documents are gathered into blocks of bounded bytes, staged once as compressed rows. A
block's fingerprints are sorted runs, cut into buckets by their leading bits; a bucket
merges the runs of all blocks and answers each block with one bit per fingerprint: whether
another block has it too. A fingerprint thus leaves a block once however often it occurs
there, so a passage that a third of the corpus holds is no hot key, and no document or
position travels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, stage, trim, windows

BLOCK_BYTES = 8_000_000
MOST_DOCS = 200_000
RUN = "bucket int, block long, data binary"
ANSWER = "block long, bucket int, flags binary"


def _pack_docs(ids: list, texts: list[bytes]) -> bytes:
    table = pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_binary())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_batch(table)
    return zstandard.ZstdCompressor(3).compress(sink.getvalue().to_pybytes())


def unpack_docs(payload: bytes) -> tuple[list, list[bytes]]:
    data = zstandard.ZstdDecompressor().decompress(payload)
    batch = pa.ipc.open_stream(data).read_next_batch()
    return batch.column(0).to_pylist(), batch.column(1).to_pylist()


def make_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, doc_bytes: int = 0) -> DataFrame:
    """Stages (block, n_docs, n_bytes, payload); null text is empty. A text longer than a block is a block.

    Every document counts ``doc_bytes`` besides its text, which bounds what a block of short texts holds.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        ids, texts, held = [], [], 0

        def out():
            return pa.record_batch({"block": pa.array([block], pa.int64()), "n_docs": pa.array([len(ids)], pa.int64()), "n_bytes": pa.array([held], pa.int64()), "payload": pa.array([_pack_docs(ids, texts)], pa.binary())})

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if ids and (held + len(data) + doc_bytes > block_bytes or len(ids) >= MOST_DOCS):
                    yield out()
                    block, ids, texts, held = block + 1, [], [], 0
                ids.append(doc_id)
                texts.append(data)
                held += len(data) + doc_bytes
        if ids:
            yield out()
        del ids, texts
        trim()

    return stage(docs.select("doc_id", "text").mapInArrow(work, "block long, n_docs long, n_bytes long, payload binary"), "blocks")


# --- runs ---------------------------------------------------------------------


def pack_sorted(v: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit values as differences, in byte planes of the least width that fits."""
    d = np.diff(v, prepend=np.uint64(0))
    width = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
    first = int(d[0]) if len(d) else 0
    if len(d) > 1:
        width = max(1, (int(d[1:].max()).bit_length() + 7) // 8)
        d = d.copy()
        d[0] = 0
    planes = d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.copy()
    return len(v).to_bytes(4, "little") + bytes([width]) + first.to_bytes(8, "little") + planes.tobytes()


def packed_size(data: bytes) -> int:
    return 13 + int.from_bytes(data[:4], "little") * data[4]


def unpack_sorted(data: bytes) -> np.ndarray:
    n, width, first = int.from_bytes(data[:4], "little"), data[4], int.from_bytes(data[5:13], "little")
    if n == 0:
        return np.empty(0, np.uint64)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, 13).reshape(width, n).T
    d = out.reshape(-1).view("<u8").astype(np.uint64) if n > 1 else np.zeros(1, np.uint64)
    d[0] = np.uint64(first)
    return np.cumsum(d, dtype=np.uint64)


def cuts(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted keys fall into, and where each begins: buckets are equal slices of the 64-bit range."""
    if n_buckets == 1 or not len(keys):
        return np.zeros(min(1, len(keys)), np.int64), np.array([0, len(keys)][: 1 + (len(keys) > 0)])
    bucket = keys // np.uint64(-(-(1 << 64) // n_buckets))
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return bucket[first].astype(np.int64), np.append(first, len(keys))


def runs_of(keys: np.ndarray, block: int, n_buckets: int, second: np.ndarray | None = None) -> list[tuple[int, int, bytes]]:
    """Rows (bucket, block, data) of sorted distinct keys, with a second half for keys of 128 bits."""
    buckets, edges = cuts(keys, n_buckets)
    out = []
    for i, a, b in zip(buckets.tolist(), edges.tolist(), edges[1:].tolist(), strict=False):
        out.append((i, block, pack_sorted(keys[a:b]) + (b"" if second is None else second[a:b].astype("<u8").tobytes())))
    return out


def _meet(data: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """Merges runs: their sizes, the order of all keys, the keys and second halves in it, and which equal the one after them.

    Equal keys are in the order of their runs.
    """
    keys = [unpack_sorted(d) for d in data]
    sizes = [len(k) for k in keys]
    all_keys = np.concatenate(keys)
    order = np.argsort(all_keys, kind="stable")
    s, t = all_keys[order], None
    same = s[1:] == s[:-1]
    if len(data[0]) > packed_size(data[0]):
        second = np.concatenate([np.frombuffer(d, "<u8", offset=packed_size(d)) for d in data])
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        order[tied] = order[tied][np.lexsort((second[order[tied]], s[tied]))]
        t = second[order]
        same &= t[1:] == t[:-1]
    return sizes, order, s, t, same


def _answers(bucket: int, blocks: list[int], sizes: list[int], flag: np.ndarray, late: np.ndarray | None) -> pa.Table:
    out, at = [], 0
    for n in sizes:
        out.append(np.packbits(flag[at : at + n]).tobytes() + (b"" if late is None else np.packbits(late[at : at + n]).tobytes()))
        at += n
    return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": pa.array([bucket] * len(blocks), pa.int32()), "flags": pa.array(out, pa.binary())})


def merge(rows: DataFrame) -> DataFrame:
    """Merges the runs of each bucket; answers every run with the bits of its keys that another block has,
    followed by the bits of those that a block of a smaller number has."""

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        sizes, order, s, _, same = _meet(table.column("data").to_pylist())
        flag, late = np.zeros(len(s), bool), np.zeros(len(s), bool)
        flag[order[1:][same]] = True
        flag[order[:-1][same]] = True
        late[order[1:][same]] = True
        return _answers(table.column("bucket")[0].as_py(), table.column("block").to_pylist(), sizes, flag, late)

    return rows.groupBy("bucket").applyInArrow(work, ANSWER)


def flags_of(answers: pa.Table, keys: np.ndarray, n_buckets: int, late: bool = False, first_bucket: int = 0) -> np.ndarray:
    """The bits of a block's sorted distinct keys, gathered from the answers of all buckets."""
    buckets, edges = cuts(keys, n_buckets)
    out, of = np.zeros(len(keys), bool), answers.column("bucket").to_numpy() - first_bucket
    mine = np.flatnonzero((of >= 0) & (of < n_buckets))
    flags = answers.column("flags")
    for i, at in zip(mine.tolist(), np.searchsorted(buckets, of[mine]).tolist(), strict=True):
        a, b = edges[at], edges[at + 1]
        skip = (b - a + 7) // 8 if late else 0
        out[a:b] = np.unpackbits(np.frombuffer(flags[i].as_py(), np.uint8, offset=skip), count=b - a).astype(bool)
    return out


# --- exchange in two steps ----------------------------------------------------

#: Most buckets that blocks send runs to straight away. Beyond that they send to lanes, the square root of the buckets in number.
FAN = 4096
PIECE = "bucket int, block long, members array<long>, data array<binary>"


def whole(n_buckets: int) -> int:
    """The number of buckets, as a power of two where lanes are needed, so that each lane is a whole number of buckets."""
    return n_buckets if n_buckets <= FAN else 1 << (n_buckets - 1).bit_length()


def lanes(n_buckets: int) -> int:
    """How many slices a block cuts its keys into, for so many buckets."""
    return n_buckets if n_buckets <= FAN else 1 << (n_buckets.bit_length() // 2)


def gathered(rows: DataFrame, blocks: DataFrame, n_lanes: int) -> DataFrame:
    """Stages pieces: the runs of up to ``n_lanes`` neighbouring blocks in one lane, about as many keys as a block has.

    Blocks are numbered by task and place, so neighbours are blocks of one task or of tasks next
    to each other. A piece is named by its first block; pieces are in the order of their blocks.
    """
    last = blocks.agg(F.max(F.col("block").bitwiseAND((1 << 33) - 1))).first()[0] or 0
    tasks, place = F.shiftright("block", 33), F.col("block").bitwiseAND((1 << 33) - 1)
    group = F.shiftleft(F.floor(tasks / max(1, n_lanes // (last + 1))), 33) + F.floor(place / n_lanes)

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        members = table.column("block").to_pylist()
        return pa.table({
            "bucket": table.column("bucket")[:1], "block": pa.array(members[:1], pa.int64()),
            "members": pa.array([members], pa.list_(pa.int64())), "data": pa.array([table.column("data").to_pylist()], pa.list_(pa.binary())),
        })

    return stage(rows.withColumn("group", group).groupBy("bucket", "group").applyInArrow(work, PIECE), "pieces")


def _spaces(widths: list[int]) -> list[tuple[int, int, int, int]]:
    """(first lane, lanes, first bucket, buckets) of key spaces that lie one after the other."""
    out, lane, bucket = [], 0, 0
    for n in widths:
        out.append((lane, lanes(n), bucket, n))
        lane, bucket = lane + lanes(n), bucket + n
    return out


def piece_runs(pieces: DataFrame, widths: list[int]) -> DataFrame:
    """The runs (bucket, block, data) of all pieces: every key once a piece, in the buckets of its key space."""
    spaces = _spaces(widths)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lane, piece, _, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first, n = next((b, n) for a, k, b, n in spaces if a <= lane < a + k)
                _, _, s, t, same = _meet(data)
                new = np.append(True, ~same)
                runs = runs_of(s[new], piece, n, None if t is None else t[new])
                yield from run_table([(first + i, j, d) for i, j, d in runs]).to_batches()
                trim()

    return pieces.mapInArrow(work, RUN)


def spread(pieces: DataFrame, answers: DataFrame, widths: list[int], with_late: bool = True) -> DataFrame:
    """Answers to the blocks, of the answers to their pieces: a key repeats in its piece or elsewhere.

    Without ``with_late`` the answers have no bits on blocks of smaller numbers.
    """
    spaces = _spaces(widths)
    lane = F.lit(None).cast("int")
    for a, k, b, n in spaces:
        lane = F.when((F.col("bucket") >= b) & (F.col("bucket") < b + n), F.floor((F.col("bucket") - b) / (n // k)).cast("int") + a).otherwise(lane)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        bucket = left.column("bucket")[0].as_py()
        first, n = next((b, n) for a, k, b, n in spaces if a <= bucket < a + k)
        sizes, order, s, _, same = _meet(left.column("data")[0].as_py())
        new = np.append(True, ~same)
        which = np.cumsum(new) - 1
        flag, late = np.empty(len(s), bool), np.empty(len(s), bool) if with_late else None
        again = np.append(False, same) | np.append(same, False)
        keys = s[new]
        flag[order] = again | flags_of(right, keys, n, first_bucket=first)[which]
        if with_late:
            late[order] = ~new | flags_of(right, keys, n, late=True, first_bucket=first)[which]
        return _answers(bucket, left.column("members")[0].as_py(), sizes, flag, late)

    right = answers.withColumn("lane", lane)
    return pieces.withColumnRenamed("bucket", "lane").withColumn("bucket", F.col("lane")).groupBy("lane", "block").cogroup(right.groupBy("lane", "block")).applyInArrow(work, ANSWER)


def exchange(rows: DataFrame, blocks: DataFrame, widths: list[int]) -> DataFrame:
    """Answers to the runs of blocks, which are cut into the lanes of key spaces with ``widths`` buckets.

    Up to FAN buckets a lane is a bucket. Beyond that neighbouring blocks' runs meet in pieces first, so a
    block and a piece send at most as many rows as the square root of the buckets, whatever their number.
    """
    if all(lanes(n) == n for n in widths):
        return merge(rows)
    pieces = gathered(rows, blocks, max(lanes(n) for n in widths))
    return spread(pieces, stage(merge(piece_runs(pieces, widths)), "piece-answers"), widths)


def with_answers(blocks: DataFrame, answers: DataFrame, work: Callable, schema: str) -> DataFrame:
    """Calls work(block, payload, answers) for each block; it gives an Arrow table."""

    def call(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(left.column("block")[0].as_py(), left.column("payload")[0].as_py(), right)
        trim()
        return out

    return blocks.select("block", "payload").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(call, schema)


def per_block(blocks: DataFrame, work: Callable, schema: str) -> DataFrame:
    """Calls work(block, payload) for each block; it gives an Arrow table."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0), batch.column(1), strict=True):
                yield from work(block.as_py(), payload.as_py()).to_batches()
                trim()

    return blocks.select("block", "payload").mapInArrow(call, schema)


def bucket_count(n_keys: int, per_bucket: int = 3_000_000) -> int:
    return whole(max(12, -(-n_keys // per_bucket)))


def run_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.int64()), "data": pa.array([r[2] for r in rows], pa.binary())})


def total_bytes(blocks: DataFrame) -> int:
    return blocks.agg(F.sum("n_bytes")).first()[0] or 0


# --- content-defined anchors --------------------------------------------------


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


class Anchors:
    """For every window of ``width`` elements inside a document, the anchor it selects.

    The anchor is the leftmost ``gram`` of the window with the smallest hash, so equal windows
    select the same gram at the same place: a window whose anchor's gram is an anchor nowhere
    else has no equal. One gram in about (width - gram + 2) / 2 is an anchor.
    """

    def __init__(self, hashes: np.ndarray, sizes: list[int], width: int, gram: int):
        n = len(hashes)
        ends = np.repeat(np.cumsum(sizes), sizes) if n else np.empty(0, np.int64)
        grams = windows(hashes, gram)
        if n >= width:
            place = np.arange(len(grams), dtype=np.uint64)
            least = sliding_min((grams & np.uint64(0xFFFFFFFF00000000)) | place, width - gram + 1)
            self.starts = np.flatnonzero(np.arange(n - width + 1) + width <= ends[: n - width + 1])
            owner = (least[self.starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        else:
            self.starts = owner = np.empty(0, np.int64)
        new = np.ones(len(owner), bool)
        new[1:] = owner[1:] != owner[:-1]
        self.which = np.cumsum(new) - 1  # index of each window's anchor
        self.owners = owner[new]
        self.first = np.flatnonzero(new)  # first window of each anchor; windows of one anchor follow each other
        values = mix(grams[self.owners]) if len(owner) else np.empty(0, np.uint64)
        self.keys, self.key_of, counts = np.unique(values, return_inverse=True, return_counts=True)
        self.local = counts > 1  # grams that are an anchor twice in this block


def anchor_answers(blocks: DataFrame, read: Callable, width: int, gram: int, n_buckets: int) -> DataFrame:
    """Staged answers on the anchors of all blocks, by lane. read(payload) gives (.., element hashes, sizes)."""
    n_lanes = lanes(n_buckets)

    def send(block: int, payload: bytes) -> pa.Table:
        *_, hashes, sizes = read(payload)
        return run_table(runs_of(Anchors(hashes, sizes, width, gram).keys, block, n_lanes))

    return stage(exchange(per_block(blocks, send, RUN), blocks, [n_buckets]), "anchors")
