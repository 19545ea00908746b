"""Vector expressions and the default embedder."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Models by id, as (provider, model name, dimensions); the first is the default.
MODELS = {
    "minilm-l12": ("onnx", "Xenova/paraphrase-multilingual-MiniLM-L12-v2", 384),
    "nomic-embed": ("ollama", "nomic-embed-text", 768),
    "bge-m3": ("ollama", "bge-m3", 1024),
    "multilingual-e5": ("ollama", "multilingual-e5-large", 1024),
}


def model_id(name: str) -> str:
    """The id of a model given by id or by model name."""
    for key, (_, model, _) in MODELS.items():
        if name in (key, model):
            return key
    raise ValueError(f"unknown model {name!r}, one of {', '.join(MODELS)}")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the dimensions that both have, in double precision; 0 for null, empty or zero vectors."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(b) > 0)
    return F.coalesce(F.when(usable, F.when(norms > 0, dot(x, y) / norms).otherwise(0.0)), F.lit(0.0))


def l2_normalize(v: Column) -> Column:
    """A zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def hash_vector(words: list[str], dimensions: int) -> np.ndarray:
    out = np.zeros(dimensions, dtype=np.float64)
    for w in words:
        h = zlib.crc32(w.encode())
        out[h % dimensions] += 1 if h >> 31 else -1
    norm = np.sqrt((out * out).sum())
    return (out / norm if norm else out).astype(np.float32)


#: Words that are hashed at once in a task's Python.
PIECE = 250_000


def hash_vectors(lists: pa.Array, dimensions: int) -> pa.Array:
    """hash_vector of each list of words; no word becomes an object but the different ones of some lists at a time."""
    sizes = pc.coalesce(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, out, start = np.cumsum(sizes), [np.zeros((0, dimensions), dtype=np.float32)], 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PIECE, side="right")))
        words = lists.slice(start, stop - start).flatten().dictionary_encode()
        hashes = np.array([zlib.crc32(w.encode()) for w in words.dictionary.to_pylist()], dtype=np.int64)[words.indices.to_numpy()] if len(words) else np.zeros(0, dtype=np.int64)
        cell = np.repeat(np.arange(stop - start), sizes[start:stop]) * dimensions + hashes % dimensions
        sums = np.bincount(cell, np.where(hashes >> 31, 1.0, -1.0), (stop - start) * dimensions).reshape(-1, dimensions)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        out.append((sums / np.where(norms > 0, norms, 1)).astype(np.float32))
        start = stop
    values = np.concatenate(out)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * dimensions), pa.array(values.reshape(-1)))


def hashing_embedder(dimensions: int = 384):
    """A deterministic stand-in for a model: signed counts of hashed tokens, normalised. array<string> -> array<float>."""

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield hash_vectors(lists, dimensions)

    return embed
