"""Reading and writing bytes at any path that the session can reach: POSIX paths directly, others through Arrow."""

from __future__ import annotations

import glob
import os
import shutil
import uuid
from urllib.parse import urlparse


def is_local(path: str) -> bool:
    return urlparse(path).scheme in ("", "file")


def local(path: str) -> str:
    return urlparse(path).path if path.startswith("file:") else path


def open_read(path: str):
    if is_local(path):
        return open(local(path), "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def write_whole(path: str, data: bytes) -> None:
    """The file appears whole under its name or not at all."""
    if is_local(path):
        path = local(path)
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(name), recursive=True)
    part = f"{name}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, name)


def join_files(path: str, start: bytes, files: list[str]) -> None:
    """``start`` and the files in a row as one file, which appears whole or not at all."""
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    if is_local(path):
        with open(local(part), "wb") as out:
            _copy(out, start, files)
    else:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(part)
        with store.open_output_stream(name) as out:
            _copy(out, start, files)
    move(part, path)


def _copy(out, start: bytes, files: list[str]) -> None:
    out.write(start)
    for f in files:
        with open_read(f) as source:
            while data := source.read(16 << 20):
                out.write(data)


def delete_folder(path: str) -> None:
    if is_local(path):
        shutil.rmtree(local(path), ignore_errors=True)
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    if store.get_file_info(name).type == fs.FileType.Directory:
        store.delete_dir(name)


def exists(path: str) -> bool:
    if is_local(path):
        return os.path.exists(local(path))
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.get_file_info(name).type != fs.FileType.NotFound


def move(source: str, target: str) -> None:
    """Renames a file over whatever has the target's name."""
    if is_local(source):
        os.replace(local(source), local(target))
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(source)
    store.move(name, fs.FileSystem.from_uri(target)[1])


def delete(path: str) -> None:
    """Deletes a file that may be gone already."""
    if is_local(path):
        if os.path.exists(local(path)):
            os.remove(local(path))
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    if store.get_file_info(name).type == fs.FileType.File:
        store.delete_file(name)


def files_of(path: str, suffix: str) -> list[str]:
    """The file itself, or the folder's files with the suffix, or what a pattern matches; in order."""
    if not is_local(path):
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        info = store.get_file_info(name)
        if info.type == fs.FileType.File:
            return [path]
        base = path.rstrip("/")
        return sorted(f"{base}/{os.path.relpath(i.path, name)}" for i in store.get_file_info(fs.FileSelector(name, recursive=True)) if i.path.endswith(suffix))
    path = local(path)
    if os.path.isdir(path):
        return sorted(glob.glob(f"{glob.escape(path)}/**/*{suffix}", recursive=True))
    found = sorted(glob.glob(path)) or ([path] if os.path.exists(path) else [])
    if not found:
        raise FileNotFoundError(path)
    return found
