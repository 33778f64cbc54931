"""Named NumPy arrays in the shared folder, written by tasks and memory-mapped by workers.

A file appears under its name only when it is whole, so a task that runs twice does no harm. Where the shared
folder isn't a mounted one, arrays are read into memory.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
from pyarrow import fs as pafs


def _at(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root if "://" in root else root.replace("file:", "file://", 1) if root.startswith("file:") else f"file://{root}")


def put(root: str, name: str, **arrays: np.ndarray) -> None:
    fs, path = _at(root)
    fs.create_dir(f"{path}/{name}", recursive=True)
    for k, a in arrays.items():
        part = f"{path}/{name}/.{k}-{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as out:
            buf = io.BytesIO()
            np.save(buf, a)
            out.write(buf.getbuffer())
        fs.move(part, f"{path}/{name}/{k}.npy")


def get(root: str, name: str, *keys: str) -> list[np.ndarray]:
    fs, path = _at(root)
    if isinstance(fs, pafs.LocalFileSystem):
        return [np.load(f"{path}/{name}/{k}.npy", mmap_mode="r") for k in keys]
    out = []
    for k in keys:
        with fs.open_input_file(f"{path}/{name}/{k}.npy") as f:
            out.append(np.load(io.BytesIO(f.read())))
    return out


def put_text(root: str, name: str, text: str) -> None:
    """A small file, which replaces one of that name at once."""
    fs, path = _at(root)
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(text.encode())
    fs.move(part, f"{path}/{name}")


def get_text(root: str, name: str) -> str | None:
    """The file's text; None if there is no such file."""
    fs, path = _at(root)
    if fs.get_file_info(f"{path}/{name}").type == pafs.FileType.NotFound:
        return None
    with fs.open_input_file(f"{path}/{name}") as f:
        return f.read().decode()
