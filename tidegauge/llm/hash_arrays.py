"""Sorted 64-bit hashes with a value each, in files that workers map into memory."""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folder_uri(folder: str) -> str:
    """A folder of the cluster as a URI."""
    return folder if "://" in folder else "file://" + folder.removeprefix("file:")


def make_folder(folder: str) -> str:
    uri = folder_uri(folder)
    filesystem, base = pafs.FileSystem.from_uri(uri)
    filesystem.create_dir(base, recursive=True)
    return uri


def save(uri: str, name: str, data: np.ndarray) -> None:
    """Write an array; it appears under its name only when whole, whatever becomes of the attempt."""
    filesystem, base = pafs.FileSystem.from_uri(uri)
    attempt = f"{base}/{name}.{uuid.uuid4().hex}"
    with filesystem.open_output_stream(attempt) as out:
        out.write(np.ascontiguousarray(data).tobytes())
    filesystem.move(attempt, f"{base}/{name}")


@lru_cache(maxsize=4096)
def load(uri: str, name: str, dtype: str) -> np.ndarray:
    """An array, mapped where the folder is mounted and read where it is not; none is empty."""
    filesystem, base = pafs.FileSystem.from_uri(uri)
    path = f"{base}/{name}"
    if not (filesystem.get_file_info(path).size or 0):
        return np.zeros(0, dtype)
    if isinstance(filesystem, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with filesystem.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def save_table(df: DataFrame, folder: str, bits: int) -> str:
    """Write columns ``key`` and ``value`` (longs, keys distinct) as arrays in 2**bits buckets of the key."""
    uri = make_folder(folder)

    def run(batches):
        keys, values = [], []
        bucket = None
        for b in batches:
            keys.append(b.column("key").to_numpy())
            values.append(b.column("value").to_numpy())
            bucket = b.column("bucket")[0].as_py() if b.num_rows else bucket
        if bucket is not None:
            k = np.concatenate(keys).view(np.uint64)
            v = np.concatenate(values)
            of = k >> np.uint64(64 - bits)
            order = np.argsort(k)
            cuts = np.searchsorted(of[order], np.arange((1 << bits) + 1))
            for i in np.flatnonzero(np.diff(cuts)):
                own = order[cuts[i]:cuts[i + 1]]
                save(uri, f"{i}.keys", k[own].astype("<u8"))
                save(uri, f"{i}.values", v[own].astype("<i8"))
            yield pa.RecordBatch.from_arrays([pa.array([len(k)])], ["n"])

    bucket = F.shiftrightunsigned("key", 64 - bits).alias("bucket")
    df.select("key", "value", bucket).repartition(1 << bits, "bucket").mapInArrow(run, "n long").count()
    return uri


def find(uri: str, bits: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each unsigned key is there, and its value (0 if not)."""
    order = np.argsort(keys)
    there, values = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    ordered = keys[order]
    cuts = np.searchsorted(ordered >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
    for i in np.flatnonzero(np.diff(cuts)):
        own = load(uri, f"{i}.keys", "<u8")
        if not len(own):
            continue
        rows = order[cuts[i]:cuts[i + 1]]
        at = np.minimum(np.searchsorted(own, keys[rows]), len(own) - 1)
        hit = own[at] == keys[rows]
        there[rows] = hit
        values[rows[hit]] = load(uri, f"{i}.values", "<i8")[at[hit]]
    return there, values
