"""Hooks for text models: embedding and completion. The defaults are deterministic and need no network."""

import itertools
import re
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]
TextModel = Callable[[str], str]
#: What a prompt is about stands behind this line.
MATERIAL = "### Material"


def hashed_encoder(dims: int = 64) -> Encoder:
    """Signed counts of hashed words."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(word.encode())
                row[h % dims] += 1 if h >> 31 else -1
        return out

    return encode


def extractive_model() -> TextModel:
    """Replies with the first three lines of the material as a list."""

    def reply(prompt: str) -> str:
        lines = (x.strip() for x in prompt.partition(MATERIAL)[2].splitlines())
        return "\n".join(f"- {x}" for x in [x for x in lines if x][:3])

    return reply


def recalling_model() -> TextModel:
    """Answers with the first line of the memory that ranks first."""

    def reply(prompt: str) -> str:
        found = re.search(r"^Content: (?:User: )?(.*)$", prompt, re.M)
        return found[1] if found else ""

    return reply


def key_list(listed: str | None = None, path: str | None = None, single: str | None = None) -> list[str]:
    """Access keys for a hosted model: of a comma list, else the lines of a file, else the single one; the first that has any."""
    found = [k.strip() for k in (listed or "").split(",") if k.strip()]
    if not found and path:
        with open(path, encoding="utf-8") as f:
            found = [k.strip() for k in f if k.strip()]
    return found or [k for k in [(single or "").strip()] if k]


def rotating(make: Callable[[str], TextModel], keys: list[str]) -> TextModel:
    """A model that takes the keys in turn, a worker on its own; the next try of a failed prompt thus has another key."""
    if not keys:
        raise ValueError("no keys")
    models, turn = [make(k) for k in keys], itertools.cycle(range(len(keys)))
    return lambda prompt: models[next(turn)](prompt)


#: Texts that a worker holds as Python strings at once; a batch of Arrow, up to 64 MB, is not copied as a whole.
PIECE = 256


def _pieces(texts: pa.Array) -> Iterator[list[str | None]]:
    for at in range(0, len(texts), PIECE):
        yield texts.slice(at, PIECE).to_pylist()


def embedding(c: Column, make: Callable[[], Encoder] = hashed_encoder) -> Column:
    """Unit vectors, zero vectors unchanged; null texts count as empty. The encoder is made once per task and called for PIECE texts at most."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = make()
        for texts in batches:
            out = [pa.array([], pa.list_(pa.float32()))]
            for piece in _pieces(texts):
                v = encode([t or "" for t in piece])
                n = np.linalg.norm(v, axis=1, keepdims=True)
                v = (v / np.where(n == 0, 1, n)).astype(np.float32)
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.reshape(-1))))
            yield pa.concat_arrays(out)

    return run(c)


def replies(prompt: Column, make: Callable[[], TextModel] = extractive_model, tries: int = 3, wait: float = 0.0) -> Column:
    """struct<reply, error> of prompts: a prompt whose tries all fail has the last error's text and an empty reply, and so has a null prompt.

    ``wait`` seconds grow with each try.
    """

    @F.arrow_udf("struct<reply: string, error: string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()

        def one(text: str | None) -> tuple[str, str | None]:
            error = "no prompt"
            for n in range(tries if text is not None else 0):
                try:
                    return model(text), None
                except Exception as e:  # whatever the hook raises is told in the result
                    error = f"{type(e).__name__}: {e}"
                    time.sleep(wait * (n + 1))
            return "", error

        for texts in batches:
            given = [one(t) for piece in _pieces(texts) for t in piece]
            yield pa.StructArray.from_arrays([pa.array([x[i] for x in given], pa.string()) for i in (0, 1)], ["reply", "error"])

    return run(prompt)


def completion(prompt: Column, make: Callable[[], TextModel] = extractive_model, tries: int = 3, wait: float = 0.0) -> Column:
    """Replies to prompts; empty where all tries failed (``replies`` tells why)."""
    return replies(prompt, make, tries, wait)["reply"]
