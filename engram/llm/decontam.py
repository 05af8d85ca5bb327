"""Benchmark decontamination: n-gram seeds, rarest first, then Smith-Waterman alignment.

Words are case-folded (all of Unicode) runs without ASCII punctuation. Every run of ``n`` words of a
test item is a seed. A document that holds any seed of an item is aligned with the item
around each seed's diagonal, so edited or paraphrased copies score too; document frequency
in the corpus only orders the regions. Scores: match 2, other pair -1, gap -1, divided by
twice the item's words.

Test items are taken as queries in blocks of bounded bytes, each block against all
documents; the document side is never shuffled by a seed, so a passage that a third of the
corpus holds is no hot key.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, settle, stage, text_key, trim, windows, word_hashes

_PUNCTUATION = bytes(c for c in range(128) if not chr(c).isalnum())
_BLANK = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))
RESULT = "doc_id long, item_id long, score double, n_item_words int, start_word int, end_word int"


def fold_words(text: str | None) -> list[bytes]:
    return (text or "").casefold().encode("utf-8", "surrogatepass").translate(_BLANK).split()


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of word-hash arrays and the end of its run in ``b``."""
    steps = np.arange(1, len(b) + 1)
    row, best, end = np.zeros(len(b) + 1, np.int64), 0, 0
    for x in a:
        t = np.maximum(np.where(b == x, 2, -1) + row[:-1], row[1:] - 1)
        np.maximum(t, 0, out=t)
        row[1:] = np.maximum.accumulate(t + steps) - steps  # gaps along b
        i = int(row.argmax())
        if row[i] > best:
            best, end = int(row[i]), i
    return best, end


def best_region(item: np.ndarray, doc: np.ndarray, diagonals: np.ndarray, counts: np.ndarray, least: float) -> tuple[int, int, int]:
    """Score, start and end in the document of the best alignment through seeds on the given diagonals.

    An alignment that scores ``least`` leaves its seed's diagonal by ``pad`` words at most and
    spans at most ``len(item) + pad`` words of the document. Regions are tried by their rarest
    seed; one with too few of the item's words in every such span is not aligned. Of equal
    scores the first in the document is taken, so the order decides nothing.
    """
    pad, best = max(0, int(2 * len(item) - least)), (0, 0, 0)
    order = np.argsort(diagonals, kind="stable")
    d, c = diagonals[order], counts[order]
    first = np.append(0, np.flatnonzero(np.diff(d) > len(item) + 2 * pad) + 1)
    last = np.append(first[1:], len(d)) - 1
    for k in np.argsort(np.minimum.reduceat(c, first), kind="stable"):
        lo, hi = max(0, int(d[first[k]]) - pad), min(len(doc), int(d[last[k]]) + len(item) + pad)
        width = min(len(item) + pad, hi - lo)
        shared = np.append(0, np.cumsum(np.isin(doc[lo:hi], item)))
        bound = 2 * min(len(item), int((shared[width:] - shared[: hi - lo + 1 - width]).max()))
        if bound < max(least, best[0]) or (bound == best[0] and lo > best[1]):
            continue
        got, end = align(item, doc[lo:hi])
        if got and got >= best[0]:
            _, length = align(item[::-1], doc[lo : lo + end][::-1])
            if got > best[0] or lo + end - length < best[1]:
                best = (got, lo + end - length, lo + end)
    return best


class Items:
    """A block of test items, by row, and where their n-grams stand: arrays sorted by hash, per width of n-grams."""

    def __init__(self, rows: list[tuple[int | None, str]], n: int):
        self.ids = [i for i, _ in rows]
        self.words = {k: word_hashes(w) for k, (_, t) in enumerate(rows) if (w := fold_words(t))}
        by_width = defaultdict(list)
        for k, w in self.words.items():
            width = min(n, len(w))  # an item of fewer words is one seed
            by_width[width].append((k, windows(w, width)))
        self.index = {}
        for width, found in sorted(by_width.items()):
            grams = mix(np.concatenate([g for _, g in found]) + np.uint64(width))
            item = np.repeat([k for k, _ in found], [len(g) for _, g in found])
            place = np.concatenate([np.arange(len(g)) for _, g in found])
            order = np.argsort(grams, kind="stable")
            known, first = np.unique(grams[order], return_index=True)
            self.index[width] = (known, np.append(first, len(grams)), item[order], place[order])

    def hits(self, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per width: positions in the document whose n-gram some item has, and the n-gram's number in the index."""
        for width, (known, *_) in self.index.items():
            w = mix(windows(doc, width) + np.uint64(width))
            at = np.searchsorted(known, w)
            at[at == len(known)] = 0
            p = np.flatnonzero(known[at] == w)
            if len(p):
                yield width, p, at[p]

    def grams(self, doc: np.ndarray) -> list[int]:
        """The document's distinct seeds, as signed numbers."""
        found = [self.index[width][0][at] for width, _, at in self.hits(doc)]
        return np.unique(np.concatenate(found)).view(np.int64).tolist() if found else []

    def seeds(self, doc: np.ndarray, counts: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per item: the diagonals of its seeds in the document, and in how many documents each seed stands."""
        found = []
        for width, p, at in self.hits(doc):
            known, first, item, place = self.index[width]
            n = first[at + 1] - first[at]
            flat = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            rarity = counts[1][np.searchsorted(counts[0], known[at])]
            found.append((item[flat], np.repeat(p, n) - place[flat], np.repeat(rarity, n)))
        if found:
            item, diagonal, rarity = map(np.concatenate, zip(*found, strict=True))
            order = np.argsort(item, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(item[order])) + 1):
                yield int(item[part[0]]), diagonal[part], rarity[part]


_made: dict[str, Items] = {}


def _items(key: str, rows, n: int) -> Items:
    """The index of a block, made once per worker; only the last one is held."""
    if key not in _made:
        _made.clear()
        _made[key] = Items(rows.value, n)
    return _made[key]


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 4, min_score: float = 0.6, block_bytes: int = 16_000_000) -> DataFrame:
    """One row per (document, item) pair that aligns: doc_id, item_id, score, n_item_words, start_word, end_word.

    An item is a distinct (item_id, text), so different texts of one item_id are all searched,
    and so are those without an item_id, reported with a null one. Null or empty texts and items
    match nothing; items with equal texts are all reported; repeated documents are reported as
    often as they occur, a null doc_id as null. An item of fewer than ``n`` words must occur
    whole. Spans are in folded words of the whole text. Empty tables give an empty result;
    other columns are ignored.
    """
    return _found(docs, benchmark, n, min_score, block_bytes).drop("text_key")


def _found(docs: DataFrame, benchmark: DataFrame, n: int = 4, min_score: float = 0.6, block_bytes: int = 16_000_000) -> DataFrame:
    """The rows of ``contaminated`` with the key of the document's text."""
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    parts = []
    for k in range(n_blocks):  # a stated query set in blocks, each against all rows
        rows = {(r[0], r[1]) for r in benchmark.where(block == k).select("item_id", "text").collect() if r[1]}
        ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        parts.append(_block(docs, spark.sparkContext.broadcast(ordered), n, min_score))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _block(docs: DataFrame, rows, n: int, min_score: float) -> DataFrame:
    key = uuid.uuid4().hex

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = _items(key, rows, n)
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                got = items.grams(word_hashes(fold_words(text)))
                if got:
                    out.append((None if pd.isna(doc_id) else int(doc_id), text, got))
            yield pd.DataFrame(out, columns=["doc_id", "text", "grams"]).astype({"doc_id": "Int64"})
        trim()

    hit = stage(docs.select("doc_id", "text").mapInPandas(find, "doc_id long, text string, grams array<long>"), "seed-hits")
    seen = hit.select(F.explode("grams").alias("g")).groupBy("g").count().toPandas()  # at most the block's n-grams
    seen = seen.assign(g=seen["g"].to_numpy(np.int64).view(np.uint64)).sort_values("g")
    frequency = docs.sparkSession.sparkContext.broadcast((seen["g"].to_numpy(), seen["count"].to_numpy(np.int64)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = _items(key, rows, n)
        for b in batches:
            out = []
            for doc_id, text, of_text in zip(b["doc_id"], b["text"], b["text_key"], strict=True):
                doc = word_hashes(fold_words(text))
                for i, diagonals, rarity in items.seeds(doc, frequency.value):
                    item = items.words[i]
                    got, start, end = best_region(item, doc, diagonals, rarity, min_score * 2 * len(item))
                    if got >= min_score * 2 * len(item):
                        out.append((None if pd.isna(doc_id) else int(doc_id), items.ids[i], got / (2 * len(item)), len(item), start, end, of_text))
            columns = ["doc_id", "item_id", "score", "n_item_words", "start_word", "end_word", "text_key"]
            yield pd.DataFrame(out, columns=columns, dtype=object).astype({"doc_id": "Int64", "item_id": "Int64"})

    return hit.select("doc_id", "text", text_key().alias("text_key")).mapInPandas(score, RESULT + ", text_key long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that align with no test item, with all their columns.

    A row goes by its doc_id and the key of its text, so clean rows that share a doc_id, or
    have none, stay.
    """
    bad = _found(docs, benchmark, **options).groupBy("doc_id", F.col("text_key").alias("key")).agg(F.lit(False).alias("kept"))
    return settle(docs, bad, text_key())
