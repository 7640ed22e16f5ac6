"""What the vector operators share: vectors as checked binary rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checked(df: DataFrame, id_col: str, vector_col: str, make=None) -> DataFrame:
    """(_id, vec: float64 components as binary, class: hash of vec) of rows whose vector is usable.

    Vectors that are null or hold null or non-finite components are left out. make turns a vector into another
    array to keep, or None to leave it out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, rows, out = batch.column(1), [], []
            for i, v in enumerate(column):
                if not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                x = x if make is None else make(x) if np.isfinite(x).all() else None
                if x is not None and np.isfinite(x).all():
                    rows.append(i)
                    out.append(x.tobytes())
            hashes = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out, pa.binary()), pa.array(hashes, pa.int64())], names=["_id", "vec", "class"])

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("_id"), F.col(vector_col)).mapInArrow(run, f"_id {id_type}, vec binary, class long")


def matrix(column, dim: int, kind=np.float64) -> np.ndarray:
    """Binary vectors as rows of a matrix; shorter ones end in zeros."""
    raw = column.to_pylist()
    width = np.dtype(kind).itemsize
    if all(len(x) == width * dim for x in raw):
        return np.frombuffer(b"".join(raw), kind).reshape(-1, dim)
    out = np.zeros((len(raw), dim), kind)
    for i, x in enumerate(raw):
        v = np.frombuffer(x, kind)
        out[i, : len(v)] = v
    return out
