"""Files that tasks write for each other in the shared folder."""

from __future__ import annotations

import uuid

import numpy as np


def make_folder(folder: str) -> str:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return folder


def put(folder: str, name: str, data: bytes) -> str:
    """Write under a name of the attempt's own, then rename: a task that runs twice leaves one whole file."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    final, own = f"{root}/{name}", f"{root}/_{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        f.write(data)
    store.move(own, final)
    return final


def view(folder: str, name: str) -> np.ndarray | None:
    """Bytes of a file, mapped into memory where the folder is mounted (workers of a machine then share its pages); None if absent."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    path = f"{root}/{name}"
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        return None
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r") if info.size else np.zeros(0, np.uint8)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.uint8)
