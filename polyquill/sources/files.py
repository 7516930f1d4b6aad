"""Files by path or URI, opened where they are read: local paths and whatever stores Arrow knows (hdfs, s3, gs, abfs)."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyarrow import fs


def opened(path: str):
    """A file that can be read at any place."""
    system, inner = located(path)
    return system.open_input_file(inner)


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def listed(path: str, suffixes: Sequence[str]) -> list[tuple[str, int]]:
    """(path, bytes) of the file, or of a folder's files with one of the suffixes, in order of name."""
    system, inner = located(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) and "://" in path else ""
    info = system.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        found = [f for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(tuple(suffixes))]
    elif info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    else:
        found = [info]
    return sorted((prefix + f.path, f.size) for f in found)
