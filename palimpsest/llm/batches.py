"""Arrow batches in pieces of bounded size, and files in the shared folder."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs

#: Bytes of text that a kernel handles at once (a longer text is handled alone).
CHUNK = 2 << 20

# Arrow's buffers come from malloc, so that lean() can give them back.
pa.set_memory_pool(pa.system_memory_pool())


_caches: list = []


def for_a_task(most: int) -> Callable:
    """lru_cache for what a task has read; lean() empties it."""

    def cached(f: Callable) -> Callable:
        _caches.append(lru_cache(most)(f))
        return _caches[-1]

    return cached


def release() -> None:
    """Drop what for_a_task() holds, and give freed memory back to the system."""
    for f in _caches:
        f.cache_clear()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A mapInArrow function that keeps no memory when its task ends: workers are kept between tasks."""

    @wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return task


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each."""
    sizes = column(batch, text).cast(pa.large_binary())
    offsets = np.frombuffer(sizes.buffers()[1], np.int64, len(sizes) + 1, sizes.offset * 8) if len(sizes) else np.zeros(1, np.int64)
    i, n = 0, len(sizes)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


#: Schemes that Spark and the kernels' file systems call by different names.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a full URI.

    A path without a scheme is refused: Spark takes it from ``fs.defaultFS``, code outside Spark from
    the local disk.  ``shared.qualified`` makes it a URI.  So is a scheme that this code can't open.
    """
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        raise ValueError(f"{uri} has no scheme, so that it isn't clear in which store it lies")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    try:
        return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")
    except (pa.ArrowInvalid, NotImplementedError) as e:
        raise ValueError(f"executors can't open {scheme}: ({uri}); set spark.checkpoint.dir to a folder in a store that they can") from e


def rows_at(folder: str, what: str, columns: list[str] | None = None) -> list[dict]:
    """Rows of the Parquet files in a folder; that it is missing is an error."""
    fs, root = filesystem(folder)
    if fs.get_file_info(root).type != pafs.FileType.Directory:
        raise FileNotFoundError(f"no {what} in {folder}")
    return ds.dataset(root, filesystem=fs, format="parquet").to_table(columns=columns).to_pylist()
