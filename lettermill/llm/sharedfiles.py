"""Files in the shared folder that tasks write whole and workers map into memory."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs as pafs


def open_uri(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_arrays(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Write arrays of equal length one after another, behind that length; the
    file appears at once, so a repeated task only replaces it by its like."""
    store, path = open_uri(folder)
    store.create_dir(path, recursive=True)
    draft = f"{path}/_{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(np.array([len(arrays[0])], np.int64).tobytes())
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())
    store.move(draft, f"{path}/{name}")


def map_arrays(folder: str, name: str, kinds: list[type]) -> list[np.ndarray] | None:
    """The arrays of a file, memory-mapped; None if there is no such file. A
    file of a remote store is fetched first, and its local copy is unlinked
    as soon as it is mapped."""
    store, path = open_uri(folder)
    path = f"{path}/{name}"
    if store.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    local = path if isinstance(store, pafs.LocalFileSystem) else _fetch(store, path)
    try:
        n, at, out = int(np.fromfile(local, np.int64, 1)[0]), 8, []
        for kind in kinds:
            size = n * np.dtype(kind).itemsize
            out.append(np.memmap(local, kind, "r", at, (n,)) if n else np.zeros(0, kind))
            at += size
        return out
    finally:
        if local != path:
            os.unlink(local)


def _fetch(store: pafs.FileSystem, path: str) -> str:
    handle, local = tempfile.mkstemp()
    with os.fdopen(handle, "wb") as out, store.open_input_stream(path) as source:
        while part := source.read(1 << 22):
            out.write(part)
    return local
