"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text are computed on the executors. The trees are fitted on the
driver to the statistics of at most ``max_rows`` labelled documents (a documented bound,
drawn by a hash of doc_id), then flattened: every tree is a perfect binary tree whose
split features and thresholds lie in arrays, so a batch walks all trees level by level
with numpy indexing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, text_key, trim, unused

SYMBOLS = b"#$%&*@|<>{}[]=_~^\\/+"
STOPS = b".,;:!?\"'()-"
N_FEATURES = 26
THRESHOLD = 0.3


def features(text: str | None) -> np.ndarray:
    """Statistics of a whole text; null counts as empty. Independent of language labels, source and id."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    n_words = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    distinct = len(set(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    line_set = set(lines)
    same_next = sum(a == b for a, b in zip(words, words[1:], strict=False))
    p = byte[byte > 0] / n
    upper, lower = byte[65:91].sum(), byte[97:123].sum()
    ends = sum(1 for w in words if w[-1] in b".!?")
    ends_odd = sum(1 for w in words if w[-1] in SYMBOLS or w[-2:] == b"!!")
    out = np.array([
        np.log1p(len(data)), np.log1p(len(words)), lengths.mean(), lengths.std(), lengths.max(),
        upper / n, lower / n, byte[48:58].sum() / n, byte[128:].sum() / n, byte[10] / n,
        sum(int(byte[c]) for c in SYMBOLS) / n, sum(int(byte[c]) for c in STOPS) / n,
        byte[33] / n, byte[124] / n, byte[46] / n, byte[44] / n,
        distinct / n_words, same_next / n_words, len(line_set) / n_lines, n_lines / n_words,
        max(map(len, lines), default=0) / n, float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
        ends / n_words, ends_odd / n_words, upper / max(1, upper + lower), int(byte[58] + byte[47] + byte[64]) / n,
    ], np.float64)
    return out


def feature_matrix(texts) -> np.ndarray:
    return np.vstack([features(t) for t in texts]) if len(texts) else np.zeros((0, N_FEATURES))


@dataclass
class Trees:
    """Flattened perfect trees: node i of a tree has the children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray  # the same; rows with a value above it go right
    leaf: np.ndarray  # (trees, 2**depth)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:  # all rows are at the same level
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1.0 / (1.0 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0) -> Trees:
    """Log-loss boosting on histograms. Without rows of both labels the score is a constant."""
    inner = 2**depth - 1
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or len(set(y.tolist())) < 2:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    n_f = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(n_f)]
    binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    margin = np.full(len(y), base)
    fs, ts, ls = [], [], []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.full(width, 1e-6)
            for f in range(n_f):
                k = len(cuts[f]) + 1
                if k == 1:
                    continue
                cell = at * k + binned[:, f]
                hg = np.bincount(cell, g, width * k).reshape(width, k)
                hh = np.bincount(cell, h, width * k).reshape(width, k)
                lg, lh = hg.cumsum(1)[:, :-1], hh.cumsum(1)[:, :-1]
                tg, th = hg.sum(1, keepdims=True), hh.sum(1, keepdims=True)
                gain = lg**2 / (lh + l2) + (tg - lg) ** 2 / (th - lh + l2) - tg**2 / (th + l2)
                gain[(lh < 1) | (th - lh < 1)] = 0
                i = gain.argmax(1)
                v = gain[np.arange(width), i]
                for w in np.flatnonzero(v > best):
                    best[w] = v[w]
                    feature[first + w], threshold[first + w] = f, cuts[f][i[w]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + l2)
        margin += leaf[at]
        fs.append(feature)
        ts.append(threshold)
        ls.append(leaf)
    return Trees(np.array(fs), np.array(ts), np.array(ls), base)


def fold(doc_id="doc_id"):
    """crc32 of the identifier as text, modulo 5; 0 is held out. A null identifier is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5, F.lit(0))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> pd.DataFrame:
    """(doc_id, y, x) of at most ``max_rows`` labelled documents outside the held-out fold; of a repeated doc_id, one row."""
    usable = labels.where(F.col("quality").isin(0, 1) & (fold() != 0)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("text_key", text_key())  # bounded by max_rows

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["doc_id", "y", "text_key"]].assign(x=list(feature_matrix(b["text"].tolist())))

    found = rows.mapInPandas(work, "doc_id long, y int, text_key long, x array<double>")
    one = found.groupBy("doc_id").agg(F.min_by(F.struct("y", "x"), "text_key").alias("r")).select("doc_id", "r.y", "r.x")
    return one.toPandas().sort_values("doc_id", kind="stable")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Trees:
    """Fit on the labelled rows of ``sample``."""
    got = sample(docs, labels, max_rows)
    return fit(np.array(got["x"].tolist(), np.float64).reshape(-1, N_FEATURES), got["y"].to_numpy(np.float64))


def score(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, threshold: float = THRESHOLD, keep_columns: bool = False) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (with keep_columns: after all other columns).

    Null text counts as empty and is scored too; repeated rows get equal scores; an empty
    table gives an empty result; without usable labels the score is 0.5 everywhere.
    """
    trees = train(docs, labels, max_rows)
    model = docs.sparkSession.sparkContext.broadcast(trees)  # its size is fixed by trees and depth

    @F.pandas_udf("double")
    def rate(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(model.value.score(feature_matrix(t.tolist())))
        trim()

    value = docs.withColumn("score", rate("text"))
    shown = quoted(docs) if keep_columns else [F.col("doc_id")]
    return value.select(*shown, (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns.

    Every row is judged by its own text, null counting as empty, so repeated rows stay or go together; a null
    doc_id plays no part. An empty table gives an empty result.
    """
    own = {c: unused(docs, f"_own_{c}") for c in docs.columns if c.lower() in ("held_out", "score", "predicted")}
    kept = score(docs.withColumnsRenamed(own), labels, keep_columns=True, **options).where("predicted = 1").drop("held_out", "score", "predicted")
    return kept.withColumnsRenamed({mine: c for c, mine in own.items()})
