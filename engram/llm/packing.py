"""Harmonic packing of token sequences.

Capacity C is divided into reciprocal classes: class j holds pieces of at most C // j
tokens, and a bin of class j is closed after exactly j pieces, whatever their lengths.
Since documents may be cut, a remainder of at least C / 16 tokens is cut down to the next
lower class size, so that its bin is full but for C mod j tokens; shorter tails go whole
into the class of their length. Each worker fills its bins on its own, without a shuffle.
The bins a worker leaves open at the end are poured into full sequences, and the last
tokens are cut into powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import trim

CAPACITY = 2048
END_OF_TEXT = 1
#: Fixed value: the public pattern of byte-level pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenBytes:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    Texts go whole through a merge table made of the tokenizer's file (ids are merge ranks
    there, which is checked), several times as fast as the tokenizer with the same ids. Texts
    that hold the string of an added token, which is that token's id, go through the
    tokenizer, and so do all where the file isn't of that kind.
    """

    def __init__(self, path: str):
        self.path, self.added = path, []
        self.merge = self._merge_table(path)
        self.tokenizer = None if self.merge else self._tokenizer(path)

    @staticmethod
    def _tokenizer(path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def _merge_table(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocabulary, merges = model["model"]["vocab"], model["model"].get("merges", [])
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in merges]
        if model.get("normalizer") or (model.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or model["pre_tokenizer"].get("add_prefix_space"):
            return None
        if [vocabulary.get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))):
            return None
        letters = byte_letters()
        self.added = [x["content"] for x in model.get("added_tokens", [])]
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in self.added}
        return tiktoken.Encoding("engram", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _slow(self, text: str):
        self.tokenizer = self.tokenizer or self._tokenizer(self.path)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.merge:
            got = (array("I", self._slow(t) if any(x in t for x in self.added) else self.merge(t)) for t in texts)
            return [(x if sys.byteorder == "little" else np.array(x, "<u4")).tobytes() for x in got]
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def cut(n: int, start: int = 0, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """Pieces (class, start, length) of n tokens."""
    out = []
    while n > 0:
        if n * 16 < capacity:
            j, size = capacity // n, n
        else:
            j = -(-capacity // n) if n < capacity else 1
            size = capacity // j
        out.append((j, start, size))
        start, n = start + size, n - size
    return out


class Bins:
    """The open bins of one worker. Pieces are (doc_id, start, length, ids, doc_tokens)."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, with_ids: bool = False):
        self.capacity, self.sequence, self.with_ids = capacity, first_sequence, with_ids
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, length, ids, total in pieces:
            row = (doc_id, start, length, zlib.crc32(ids), total, self.sequence, offset)
            self.rows.append((*row, bytes(ids)) if self.with_ids else row)
            offset += length
        self.sequence += 1

    def add(self, doc_id, ids: bytes) -> None:
        view, total = memoryview(ids), len(ids) // 4
        for j, start, length in cut(total, 0, self.capacity):
            pieces = self.open.setdefault(j, [])
            part = view[4 * start : 4 * (start + length)]
            pieces.append((doc_id, start, length, part if j == 1 else bytes(part), total))
            if len(pieces) == j:
                self.close(self.open.pop(j))

    def flush(self) -> None:
        """Pour the open bins into full sequences; cut the last tokens into powers of two."""
        rest = [p for j in sorted(self.open) for p in self.open[j]]
        self.open, left = {}, sum(p[2] for p in rest)
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            taken = []
            while room:
                doc_id, start, length, ids, total = rest.pop(0)
                n = min(room, length)
                taken.append((doc_id, start, n, ids[: 4 * n], total))
                if n < length:
                    rest.insert(0, (doc_id, start + n, length - n, ids[4 * n :], total))
                room -= n
            self.close(taken)

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def slices(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[tuple[list, list[str]]]:
    """Rows of a batch, a bounded number of characters at a time; a longer text comes alone."""
    ids, texts, held = [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        text = text.as_py() or ""
        ids.append(doc_id)
        texts.append(text)
        held += len(text)
        if held >= most:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (, ids).

    A document is the ids of its text (null: empty) and then id 1, so an empty text is one
    token; the string of an added token in a text is that token, as the tokenizer has it. Repeated rows are packed as often as they occur; a null doc_id stays null; very
    long texts fill sequences of their own; an empty table gives an empty result; other
    columns are ignored. ``tokenizer`` is a file that every worker can open.
    """

    def work(batches):
        from pyspark import TaskContext

        schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), *([("ids", pa.binary())] * with_ids)])
        encode = TokenBytes(tokenizer)
        bins = Bins(TaskContext.get().partitionId() << 33, capacity, with_ids)
        end = np.array([END_OF_TEXT], "<u4").tobytes()

        def out():
            columns = list(zip(*bins.take(), strict=True)) or [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for ids, texts in slices(batch):
                for doc_id, tokens in zip(ids, encode(texts), strict=True):
                    bins.add(doc_id, tokens + end)
                yield out()
        bins.flush()
        yield out()
        trim()

    return docs.select("doc_id", "text").mapInArrow(work, PIECES + ", ids binary" * with_ids)
