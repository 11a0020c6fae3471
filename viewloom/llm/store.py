"""Flat files in the shared folder that tasks write once and workers memory-map.

A folder is a full URI (common.scratch_folder gives one), so that tasks on every machine mean the same place.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

import numpy as np


KINDS = ("<u8", "<i8", "<u4", "|u1")


def _local(folder: str) -> str | None:
    """The path of a folder on a file system that is mounted here, else None."""
    parts = urlparse(folder)
    if not parts.scheme:
        raise ValueError(f"{folder} has no scheme: it may mean another place on another machine")
    return parts.path if parts.scheme == "file" else None


def put(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Write arrays one after the other. A repeated task writes the same bytes; readers never see half a file."""
    head = np.array([len(arrays), *(x for a in arrays for x in (KINDS.index(a.dtype.str), len(a)))], np.int64)
    parts = [head, *arrays]
    if path := _local(folder):
        os.makedirs(path, exist_ok=True)
        draft = f"{path}/.{name}-{uuid.uuid4().hex}"
        with open(draft, "wb") as f:
            for a in parts:
                f.write(a.tobytes())
                f.write(b"\0" * (-a.nbytes % 8))
        os.replace(draft, f"{path}/{name}")
        return
    from pyarrow import fs

    remote, path = fs.FileSystem.from_uri(folder)
    remote.create_dir(path, recursive=True)
    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
    with remote.open_output_stream(draft) as f:
        for a in parts:
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    remote.move(draft, f"{path}/{name}")


#: A worker keeps so many mapped files open, and so many bytes of files of a store that is not mounted.
KEPT_FILES, KEPT_BYTES = 1024, 128 << 20
_kept: dict[str, list[np.ndarray]] = {}
_state = {"folder": "", "bytes": 0}


def view(folder: str, name: str) -> list[np.ndarray]:
    """The arrays of a file, memory-mapped, or read where the store is not mounted; a missing file is an error.

    The first files that a worker meets in a folder stay with it within a bound, so that chunks that go through all files in order find them again.
    """
    if _state["folder"] != folder:
        _kept.clear()
        _state.update(folder=folder, bytes=0)
    if name not in _kept:
        raw, mapped = _raw(folder, name)
        if len(_kept) >= KEPT_FILES or not mapped and _state["bytes"] + len(raw) > KEPT_BYTES:
            return _arrays(raw)
        _state["bytes"] += 0 if mapped else len(raw)
        _kept[name] = _arrays(raw)
    return _kept[name]


def _raw(folder: str, name: str) -> tuple[np.ndarray, bool]:
    if (path := _local(folder)) is not None:
        return np.memmap(f"{path}/{name}", np.uint8, "r"), True
    from pyarrow import fs

    remote, at = fs.FileSystem.from_uri(folder)
    with remote.open_input_file(f"{at}/{name}") as source:
        return np.frombuffer(source.read_buffer(), np.uint8), False


def _arrays(raw: np.ndarray) -> list[np.ndarray]:
    count = int(raw[:8].view(np.int64)[0])
    head = raw[8 : 8 + 16 * count].view(np.int64)
    at, found = 8 + 16 * count, []
    for kind, size in head.reshape(-1, 2).tolist():
        dtype = np.dtype(KINDS[kind])
        found.append(raw[at : at + size * dtype.itemsize].view(dtype))
        at += size * dtype.itemsize + -size * dtype.itemsize % 8
    return found
