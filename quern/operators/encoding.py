"""Texts through an encoder that may run out of memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Encodes texts into as many vectors; raises MemoryError (or a RuntimeError that says "out of memory") for too many at once.
Encoder = Callable[[list[str]], list[list[float]]]


def out_of_memory(error: Exception) -> bool:
    return isinstance(error, MemoryError) or isinstance(error, RuntimeError) and "out of memory" in str(error).lower()


def encoded(df: DataFrame, key: str, text: str, make: Callable[[], Encoder], dims: int, batch: int = 64) -> DataFrame:
    """(key, embedding, error): each text's vector, in batches of up to `batch` that are halved while the encoder runs out of memory.

    `make` is called once a task and gives the encoder. A size that failed is not tried again in the task: batches grow back to it
    only by doubling after successes. A text that is too much by itself has an error and no vector; null texts are empty. Any
    other failure, or a vector of another length, fails the job. Rows keep their order within a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = make(), batch
        for rows in batches:
            keys, texts = rows.column(0), [t or "" for t in rows.column(1).to_pylist()]
            vectors, errors, at, limit = [], [], 0, batch
            while at < len(texts):
                part = texts[at : at + size]
                try:
                    got = encode(part)
                except (MemoryError, RuntimeError) as e:
                    if not out_of_memory(e):
                        raise
                    if len(part) > 1:
                        limit = len(part) - 1
                        size = max(1, len(part) // 2)
                        continue
                    got = [None]
                    errors.append(str(e) or "out of memory")
                else:
                    if len(got) != len(part) or any(len(v) != dims for v in got):
                        raise ValueError(f"the encoder gave other than {len(part)} vectors of {dims}")
                    errors += [None] * len(part)
                    size = min(size * 2, max(limit, 1))
                vectors += got
                at += len(part)
            yield pa.RecordBatch.from_arrays([keys, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=[key, "embedding", "error"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, embedding array<float>, error string")
