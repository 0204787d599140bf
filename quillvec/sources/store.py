"""Files by URI or local path, through the file systems that pyarrow knows: the driver and every task open them alike."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def reader(path: str) -> pa.NativeFile:
    """A file to read at any place."""
    system, name = _system(path)
    return system.open_input_file(name)


def writer(path: str) -> pa.NativeFile:
    system, name = _system(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(name)


def size_of(path: str) -> int:
    """Bytes of a file, or of all files of a folder."""
    system, name = _system(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.Directory:
        return sum(f.size or 0 for f in system.get_file_info(fs.FileSelector(name, recursive=True)))
    return info.size or 0
