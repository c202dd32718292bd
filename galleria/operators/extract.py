"""The boundary at which pictures become boxes, landmarks and embeddings.

Networks aren't part of the library: an extractor is any function from bytes to faces. The default one is deterministic
and derives a face from the bytes' hash, so that pipelines run end to end and runs can be compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FACE = "box struct<x1: double, y1: double, x2: double, y2: double>, landmarks array<array<double>>, embedding array<float>, score double"
Face = tuple[dict, list[list[float]], list[float], float]


def hashed_face(content: bytes, dim: int = 512, index: int = 0) -> Face:
    """One face whose embedding is a random unit vector seeded by the content."""
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(content + bytes([index])).digest()[:8], "big"))
    v = rng.standard_normal(dim)
    x, y = (float(a) for a in rng.integers(0, 40, 2))
    return {"x1": x, "y1": y, "x2": x + 60.0, "y2": y + 60.0}, rng.uniform(0, 100, (5, 2)).tolist(), (v / np.linalg.norm(v)).astype(np.float32).tolist(), 0.95


def hashed_faces(content: bytes) -> list[Face]:
    return [hashed_face(content)]


def extract(photos: DataFrame, key: str, extractor: Callable[[bytes], list[Face]] = hashed_faces) -> DataFrame:
    """key, ordinal and FACE for each face; photos without bytes have none. photos: key, content."""
    kind = photos.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, content in zip(batch.column(key).to_pylist(), batch.column("content").to_pylist(), strict=True):
                for i, (box, landmarks, embedding, score) in enumerate(extractor(content) if content else ()):
                    rows.append({key: k, "ordinal": i, "box": box, "landmarks": landmarks, "embedding": embedding, "score": score})
            box = pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")])
            fields = [(key, batch.schema.field(key).type), ("ordinal", pa.int32()), ("box", box), ("landmarks", pa.list_(pa.list_(pa.float64()))), ("embedding", pa.list_(pa.float32())), ("score", pa.float64())]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))

    return photos.select(key, "content").mapInArrow(run, f"`{key}` {kind}, ordinal int, {FACE}")
