"""Substring dedup over bytes by distributed suffix arrays with difference covers.

Every document is a string of bytes; a byte goes if a 100-byte string that covers it also
starts earlier. Sorting all suffixes of a corpus would move each of them several times, so
the suffixes are first divided so that equal 100-byte prefixes always meet: a window goes
where its anchor goes (see blocks.Anchors; equal windows select equal anchors), and windows
whose anchor is nowhere else are known to be unique. A block sends one context per repeated
anchor, the bytes of all its windows, once for equal contexts.

Each bucket builds suffix arrays of its distinct contexts, a bounded number of bytes at a time
and never two for one anchor, unless its contexts are too many, by the difference cover modulo
3: the suffixes at positions 1 and 2 modulo 3 are named by sorted triples, the names are
ranked by recursion until they reach 100 bytes, the remaining suffixes are sorted by their
first byte and the rank behind it, and both are merged. Neighbours are then compared over
100 bytes; of equal prefixes the earliest start stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import covered, free_shuffles, mix, stage, windows

WIDTH, GRAM = 100, 32
BLOCK_BYTES = 2_000_000
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LAST = np.iinfo(np.int64).max


# --- suffix arrays ------------------------------------------------------------


def _dense(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x)
    s, out = x[order], np.empty(len(x), np.int64)
    out[order] = np.append(0, np.cumsum(s[1:] != s[:-1]))
    return out


def _below(sorted_keys: np.ndarray, keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many of sorted_keys are smaller than each key; order sorts the keys, so both are read as in a merge."""
    out = np.empty(len(keys), np.int64)
    out[order] = np.searchsorted(sorted_keys, keys[order], "left")
    return out


def suffix_ranks(t: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of t (values from 1 on) by at least their first ``depth`` elements.

    Suffixes that agree that far get ranks next to each other, in no particular order.
    """
    n = len(t)
    if n < 4:
        padded = np.concatenate([t, np.zeros(3, np.int64)])
        order = sorted(range(n), key=lambda i: padded[i:].tolist())
        out = np.empty(n, np.int64)
        out[order] = np.arange(n)
        return out
    m = n + (n % 3 == 1)  # a dummy triple keeps the two halves of the recursion apart
    v = np.zeros(m + 4, np.int64)
    v[:n] = t
    top = int(t.max()) + 1
    pair = v[:-1] * top + v[1:]
    if top > 1 << 20:
        pair = _dense(pair)
    p1, p2 = np.arange(1, m, 3), np.arange(2, m, 3)
    sample = np.concatenate([p1, p2])
    name = pair[sample] * top + v[sample + 2] + 1
    if top > 1 << 9 or depth <= 3:  # names of byte triples are small enough as they are
        name = _dense(name) + 1
    if depth > 3 and (top <= 1 << 9 or int(name.max()) < len(name)):
        name = suffix_ranks(name, -(-depth // 3)) + 1
    rank = np.zeros(m + 4, np.int64)
    rank[sample] = name
    p0, wide = np.arange(0, n, 3), len(v) + int(name.max()) + 2
    a0, a1 = v[p0] * wide + rank[p0 + 1], v[p1] * wide + rank[p1 + 1]
    b0, b2 = pair[p0] * wide + rank[p0 + 2], pair[p2] * wide + rank[p2 + 2]
    oa0, oa1, ob0, ob2 = map(np.argsort, (a0, a1, b0, b2))
    sa0, sb0 = a0[oa0], b0[ob0]
    out = np.empty(m + 4, np.int64)
    out[p0] = _below(sa0, a0, oa0) + _below(a1[oa1], a0, oa0) + _below(b2[ob2], b0, ob0)
    ordered = np.sort(name)
    out[p1] = _below(ordered, rank[p1], oa1) + _below(sa0, a1, oa1)
    out[p2] = _below(ordered, rank[p2], ob2) + _below(sb0, b2, ob2)
    return out[:n]


def equal_prefixes(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts in suffix order, and a number for each that equal prefixes of ``width`` bytes share."""
    ranks = suffix_ranks(data.astype(np.int64) + 1, width)
    order = starts[np.argsort(ranks[starts], kind="stable")]
    same = np.ones(max(0, len(order) - 1), bool)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.zeros(len(data), np.uint64)
    for k in range(8):
        words |= padded[k : k + len(data)].astype(np.uint64) << np.uint64(8 * k)
    for k in [*range(0, width - 8, 8), width - 8]:
        w = words[order + k]
        same &= w[1:] == w[:-1]
    return order, np.append(0, np.cumsum(~same)) if len(order) else np.empty(0, np.int64)


# --- contexts -----------------------------------------------------------------


def read(payload: bytes):
    """Identifiers, the block's bytes, a hash per byte, bytes per document."""
    ids, texts = B.unpack_docs(payload)
    data = b"".join(texts)
    return ids, data, _LETTERS[np.frombuffer(data, np.uint8)], [len(t) for t in texts]


class Contexts:
    """The distinct contexts of a block's repeated anchors, each at its earliest place."""

    def __init__(self, ids: list, data: bytes, hashes: np.ndarray, sizes: list[int], answers: pa.Table, n_anchor: int, n_bucket: int):
        a = B.Anchors(hashes, sizes, WIDTH, GRAM)
        hot = np.flatnonzero((a.local | B.flags_of(answers, a.keys, n_anchor))[a.key_of]) if len(a.keys) else np.empty(0, np.int64)
        last = np.append(a.first[1:], len(a.starts)) - 1
        self.lo, self.hi = a.starts[a.first[hot]], a.starts[last[hot]]
        edge = np.append(0, np.cumsum(sizes))
        doc = np.searchsorted(edge, self.lo, "right") - 1
        key = np.array([_LAST if i is None else i for i in ids], np.int64)[doc] if len(hot) else np.empty(0, np.int64)
        order = np.lexsort((self.lo, key))
        seen: dict[bytes, int] = {}
        first = []
        for i in order.tolist():
            if seen.setdefault(data[self.lo[i] : self.hi[i] + WIDTH], i) == i:
                first.append(i)
        self.texts = list(seen)
        self.first = np.array(first, np.int64)
        self.key, self.at = key[self.first], self.lo[self.first]
        anchor = a.keys[a.key_of[hot[self.first]]] if len(first) else np.empty(0, np.uint64)
        bucket = (anchor % np.uint64(n_bucket)).astype(np.int64)
        self.anchor = anchor
        order = np.argsort(bucket, kind="stable")
        new = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])) if len(order) else order
        #: by bucket, the distinct contexts that go there
        self.members = dict(zip(bucket[order[new]].tolist(), np.split(order, new[1:]), strict=True)) if len(order) else {}

    def rows(self, block: int) -> list[tuple[int, int, bytes]]:
        out = []
        for b, mine in self.members.items():
            texts = [self.texts[i] for i in mine.tolist()]
            head = np.column_stack([[len(t) for t in texts], self.key[mine], self.at[mine], self.anchor[mine].view(np.int64)]).astype("<i8")
            body = len(texts).to_bytes(8, "little") + head.tobytes() + b"".join(texts)
            out.append((b, block, zstandard.ZstdCompressor(3).compress(body)))
        return out

    def again(self, answers: pa.Table) -> np.ndarray:
        """Starts in the block of windows that also start earlier."""
        found = []
        repeats = np.ones(len(self.lo), bool)
        repeats[self.first] = False
        for i in np.flatnonzero(repeats).tolist():  # an equal context stands earlier in this block
            found.append(np.arange(self.lo[i], self.hi[i] + 1))
        for b, flags in zip(answers.column("bucket").to_pylist(), answers.column("flags").to_pylist(), strict=True):
            mine = self.first[self.members[b]]
            starts = np.concatenate([np.arange(x, y + 1) for x, y in zip(self.lo[mine], self.hi[mine], strict=True)])
            found.append(starts[np.unpackbits(np.frombuffer(flags, np.uint8), count=len(starts)).astype(bool)])
        return np.concatenate(found) if found else np.empty(0, np.int64)


#: Bytes of the contexts that share a suffix array, about; those of one anchor beyond twice that are compared by windows.
CHUNK = 1_000_000


def late_windows(texts: list[bytes], document: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For all windows of the texts, one text after the other: whether the window also starts earlier.

    A text stands in a document, by its number in order, at a place.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = np.array([len(t) for t in texts], np.int64)
    begin, windows = np.cumsum(n) - n, n - WIDTH + 1
    text = np.repeat(np.arange(len(n)), windows)
    inside = np.arange(len(text)) - (np.cumsum(windows) - windows)[text]
    starts, when = begin[text] + inside, (document[text] << 36) + place[text] + inside
    number = np.empty(len(data), np.int64)
    number[starts] = np.arange(len(starts))
    ordered, group = equal_prefixes(data, starts, WIDTH)
    which = number[ordered]
    least = np.minimum.reduceat(when[which], np.flatnonzero(np.append(True, group[1:] != group[:-1])))
    late = np.empty(len(starts), bool)
    late[which] = when[which] > least[group]
    return late


def late_of_anchor(texts: list[bytes], document: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The same for more contexts of one anchor than a suffix array should hold: windows of equal hash are compared byte by byte."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = np.array([len(t) for t in texts], np.int64)
    count = n - WIDTH + 1
    text = np.repeat(np.arange(len(n)), count)
    inside = np.arange(len(text)) - (np.cumsum(count) - count)[text]
    starts, when = (np.cumsum(n) - n)[text] + inside, (document[text] << 36) + place[text] + inside
    hashed = windows(_LETTERS[data], WIDTH)[starts]
    order = np.lexsort((when, hashed))
    new = np.append(True, hashed[order][1:] != hashed[order][:-1])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    strings, late = np.lib.stride_tricks.sliding_window_view(data, WIDTH), np.zeros(len(order), bool)
    again = np.flatnonzero(~new)
    for at in range(0, len(again), 100_000):
        mine = again[at : at + 100_000]
        late[order[mine]] = (strings[starts[order[mine]]] == strings[starts[first[mine]]]).all(1)
    odd = again[~late[order[again]]]
    if len(odd):  # different windows of equal hash: those groups are told apart by their bytes
        seen = set()
        for i in order[np.isin(hashed[order], hashed[order[odd]])].tolist():  # by hash, then in order of time
            window = strings[starts[i]].tobytes()
            late[i] = window in seen
            seen.add(window)
    return late


def judge(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Answers each block with a bit per window it sent: whether the window also starts earlier.

    Equal windows have equal anchors, so a bucket's contexts are judged anchor by anchor, several in one suffix array.
    """

    def work(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        sizes, keys, places, anchors, texts, owner = [], [], [], [], [], []
        for k, data in enumerate(table.column("data").to_pylist()):
            body = zstandard.ZstdDecompressor().decompress(data)
            n = int.from_bytes(body[:8], "little")
            head = np.frombuffer(body, "<i8", 4 * n, 8).reshape(n, 4)
            at = 8 + 32 * n
            for size in head[:, 0].tolist():
                texts.append(body[at : at + size])
                at += size
            sizes.append(head[:, 0])
            keys.append(head[:, 1])
            places.append(head[:, 2])
            anchors.append(head[:, 3])
            owner.append(np.full(n, k))
        size, key, place, anchor, owner = map(np.concatenate, (sizes, keys, places, anchors, owner))
        block = np.array(blocks, np.int64)[owner]
        order = np.lexsort((place, block, key))
        seen: dict[bytes, int] = {}
        distinct = np.array([i for i in order.tolist() if seen.setdefault(texts[i], i) == i], np.int64)
        del seen
        k, b = key[order], block[order]
        document = np.empty(len(order), np.int64)
        document[order] = np.append(0, np.cumsum((k[1:] != k[:-1]) | (b[1:] != b[:-1])))
        gone = [None] * len(texts)  # None: all of its windows start earlier in an equal context
        d = distinct[np.argsort(anchor[distinct], kind="stable")]
        edges = np.append(np.flatnonzero(np.append(True, anchor[d][1:] != anchor[d][:-1])), len(d))
        held: list[int] = []
        full = 0

        def settle_held() -> None:
            if held:
                x = np.array(held, np.int64)
                late, at = late_windows([texts[i] for i in held], document[x], place[x]), 0
                for i, m in zip(held, (size[x] - WIDTH + 1).tolist(), strict=True):
                    gone[i] = late[at : at + m]
                    at += m
                held.clear()

        for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            mine = d[a:b]
            if len(mine) == 1:
                gone[mine[0]] = np.zeros(size[mine[0]] - WIDTH + 1, bool)
                continue
            n = int(size[mine].sum())
            if n > 2 * chunk:
                late, at = late_of_anchor([texts[i] for i in mine.tolist()], document[mine], place[mine]), 0
                for i, m in zip(mine.tolist(), (size[mine] - WIDTH + 1).tolist(), strict=True):
                    gone[i] = late[at : at + m]
                    at += m
                continue
            if full + n > chunk:
                settle_held()
                full = 0
            held += mine.tolist()
            full += n
        settle_held()
        bits = [np.ones(s - WIDTH + 1, bool) if g is None else g for s, g in zip(size.tolist(), gone, strict=True)]
        out, at = [], 0
        for s in sizes:
            out.append(np.packbits(np.concatenate(bits[at : at + len(s)])).tobytes())
            at += len(s)
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": pa.array([bucket] * len(blocks), pa.int32()), "flags": pa.array(out, pa.binary())})

    return rows.groupBy("bucket").applyInArrow(work, B.ANSWER)


def suffix_dedup(docs: DataFrame, with_bytes: bool = True, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = 10_000_000, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (, kept_bytes).

    Texts are UTF-8 bytes, null is empty, and texts under 100 bytes lose nothing. Earlier: a
    smaller doc_id (null counts as the largest), or the same document and an earlier start;
    repeated rows (equal doc_id) are ordered by their place in the staged input. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    held = B.make_blocks(docs, block_bytes)
    total = B.total_bytes(held)
    n_anchor, n_bucket = B.bucket_count(total // 30), max(12, -(-total // bucket_bytes))
    anchors = B.anchor_answers(held, read, WIDTH, GRAM, n_anchor)
    n_anchor = B.lanes(n_anchor)
    free_shuffles(spark)

    def send(block: int, payload: bytes, answers: pa.Table) -> pa.Table:
        return B.run_table(Contexts(*read(payload), answers, n_anchor, n_bucket).rows(block))

    judged = stage(judge(B.with_answers(held, anchors, send, B.RUN), chunk), "windows")
    free_shuffles(spark)
    both = judged.unionByName(anchors.withColumn("bucket", -1 - F.col("bucket")))

    def remove(block: int, payload: bytes, answers: pa.Table) -> pa.Table:
        ids, data, hashes, sizes = read(payload)
        bucket = answers.column("bucket").to_numpy()
        on_anchors = answers.filter(pa.array(bucket < 0))
        on_anchors = on_anchors.set_column(1, "bucket", pa.array(-1 - bucket[bucket < 0], pa.int32()))
        c = Contexts(ids, data, hashes, sizes, on_anchors, n_anchor, n_bucket)
        gone = covered(c.again(answers.filter(pa.array(bucket >= 0))), WIDTH, len(data))
        letters = np.frombuffer(data, np.uint8)
        rows, at = [], 0
        for doc_id, n in zip(ids, sizes, strict=True):
            mask = gone[at : at + n]
            kept = letters[at : at + n][~mask].tobytes()
            spans = int((mask[1:] & ~mask[:-1]).sum() + (n > 0 and mask[0]))
            rows.append((doc_id, n, int(mask.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
            at += n
        columns = list(zip(*rows, strict=True))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"][: 5 + with_bytes]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=False)})

    return B.with_answers(held, both, remove, RESULT + ", kept_bytes binary" * with_bytes)


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (
  SELECT doc_id, len(h) // 2 AS n, k, substr(h, 1000 * k + 1, 1198) AS piece
  FROM (SELECT doc_id, h, unnest(range((len(h) + 999) // 1000)) AS k FROM d)),
b AS (
  SELECT doc_id, n, 500 * k + o AS i, substr(piece, 2 * o + 1, 2) AS byte,
         CASE WHEN 500 * k + o + 100 <= n THEN md5_number(substr(piece, 2 * o + 1, 200)) END AS win
  FROM (SELECT *, unnest(range(500)) AS o FROM c) WHERE 500 * k + o < n),
r AS (
  SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM b),
g AS (
  SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM r),
f AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM g),
k AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
         string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept
  FROM f GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
