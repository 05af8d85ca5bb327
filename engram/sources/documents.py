"""Large JSON arrays read by many tasks.

Spark reads a file that is one JSON document in one task. Here the file is read as text that ends at
closing braces, which splits at any place: behind a brace no escape is pending, so what a task
doesn't know of the text before its split is only whether it stands inside a string, and how deep.
A first pass sums up every split for both cases; the driver chains the sums, a few numbers
for each split; a second pass cuts the elements of the array, and pieces of an element that
lies over several splits are joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_OTHER = re.compile(r"[^\[\]{}]+")
_BETWEEN = re.compile(r"[\s,\[\]﻿]*")
#: Place of an element that goes on behind its split.
LAST = (1 << 62) - 1


def _outside(text: str, inside: bool) -> tuple[str, bool]:
    """The text without its strings, and whether it ends inside one."""
    left = _STRING.sub("", f'"{text}' if inside else text)
    at = left.find('"')
    return (left, False) if at < 0 else (left[:at], True)


class Split:
    """What a part of a file does to a state (inside a string, depth): for both kinds of beginning, the change of depth, the least depth on the way, and how it ends."""

    def __init__(self):
        self.first, self.ends = "", {k: [0, 0, k] for k in (False, True)}

    def add(self, text: str) -> None:
        self.first = self.first or text.lstrip("﻿ \t\r\n")[:1]
        for end in self.ends.values():
            left, end[2] = _outside(text, end[2])
            marks = np.frombuffer(_OTHER.sub("", left).encode(), np.uint8)
            if len(marks):
                depth = end[0] + np.cumsum(np.where((marks == ord("[")) | (marks == ord("{")), 1, -1))
                end[0], end[1] = int(depth[-1]), min(end[1], int(depth.min()))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """(file, where the split begins, texts) of rows that follow each other."""
    for batch in batches:
        files, starts, texts = (batch.column(i).to_pylist() for i in range(3))
        cuts = [i for i in range(1, len(files)) if files[i] != files[i - 1] or starts[i] != starts[i - 1]]
        for a, b in zip([0, *cuts], [*cuts, len(files)], strict=True):
            if b > a:
                yield files[a], starts[a], texts[a:b]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, int], Split] = {}
    for file, start, texts in _by_split(batches):
        held.setdefault((file, start), Split()).add("}".join(texts) + "}")
    for (file, start), s in held.items():
        rows = [(file, start, s.first, inside, *end) for inside, end in s.ends.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "start", "first", "inside", "change", "least", "ends"), r, strict=True)) for r in rows], SUMS)


SUMS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("first", pa.string()), ("inside", pa.bool_()), ("change", pa.int64()), ("least", pa.int64()), ("ends", pa.bool_())])


def chained(sums: list) -> dict[tuple[str, int], tuple[bool, int, int | None]]:
    """For each split: whether it begins inside a string, its depth, and the split where the element that is open there began. Files that aren't one array raise."""
    files: dict[str, dict[int, dict]] = {}
    for r in sums:
        files.setdefault(r["file"], {}).setdefault(r["start"], {})[r["inside"]] = r
    out = {}
    for file, splits in files.items():
        inside, depth, begun = False, 0, None
        for i, start in enumerate(sorted(splits)):
            s = splits[start][inside]
            if not i and s["first"] != "[":
                raise ValueError(f"{file} is no JSON array")
            out[file, start] = (inside, depth, begun)
            closes = depth + s["least"] <= 1
            inside, depth = s["ends"], depth + s["change"]
            begun = None if depth < 2 else start if begun is None or closes else begun
        if inside or depth != -1:  # a brace is taken to follow the last text, too
            raise ValueError(f"{file} is no complete JSON array")
    return out


def _cut(states):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, element, n = None, [], 0
        inside, depth, begun = False, 0, None

        def piece(at: int, block: int, part: int | None) -> dict:
            return {"file": split[0], "block": block, "at": at, "part": part, "text": "".join(element)}

        def rest() -> list[dict]:
            return [piece(LAST, split[1] if begun is None else begun, split[1])] if element else []

        for file, start, texts in _by_split(batches):
            out = []
            if split != (file, start):
                out, split, element, n = rest() if split else [], (file, start), [], 0
                inside, depth, begun = states.value[split]
            for text in texts:
                if depth < 2 and not inside:
                    at = _BETWEEN.match(text).end()
                    if at < len(text) and text[at] != "{":
                        raise ValueError(f"{file} holds elements that are no objects: {text[at : at + 20]}")
                    if at == len(text):  # behind the last element
                        depth += text.count("[") - text.count("]") - 1
                        continue
                    depth += text[:at].count("[") - text[:at].count("]")
                    text = text[at:]
                left, inside = _outside(text, inside)
                element.append(text + "}")
                depth += left.count("{") + left.count("[") - left.count("]") - (not inside)
                if depth < 2 and not inside:
                    out.append(piece(n, start, None) if begun is None else piece(LAST, begun, start))
                    element, n, begun = [], n + (begun is None), None
            if out:
                yield pa.RecordBatch.from_pylist(out, PIECES)
        if split and (out := rest()):
            yield pa.RecordBatch.from_pylist(out, PIECES)

    return work


PIECES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("part", pa.int64()), ("text", pa.string())])


def array_elements(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, block, at, text): the objects of files that are JSON arrays of objects, in the order of the last three; other files raise."""
    rows = spark.read.option("lineSep", "}").text(paths).select("_metadata.file_path", "_metadata.file_block_start", "value")
    sums = rows.mapInArrow(_sums, "file string, start long, first string, inside boolean, change long, least long, ends boolean").collect()  # two rows a split
    states = spark.sparkContext.broadcast(chained(sums))
    pieces = rows.mapInArrow(_cut(states), "file string, block long, at long, part long, text string")
    over = pieces.where("part IS NOT NULL").groupBy("file", "block", "at").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("l"))
    over = over.select("file", "block", "at", F.array_join(F.transform("l", lambda x: x["text"]), "").alias("text"))
    whole = F.when(F.col("part").isNull(), F.col("text")).alias("text")  # what is asked of texts may be pushed before the filter, and must not see a piece
    return pieces.where("part IS NULL").select("file", "block", "at", whole).unionByName(over)


def large_arrays(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The files under a path that are larger than a task reads at a time and begin as an array, and the others."""
    most = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    files = [(r.path, r.length > most) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect()]  # names and sizes alone
    large = sorted(p for p, far in files if far)
    begins = [p for p in large if (first := spark.read.option("lineSep", "{").text(p).first()) and first[0].lstrip("﻿ \t\r\n").startswith("[")]
    return begins, sorted({p for p, _ in files} - set(begins))
