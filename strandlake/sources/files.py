"""Opening files by path or address, on any file system that the executors share.

A path without a scheme is local; ``file://``, ``hdfs://``, ``s3://`` and what
else the Arrow library knows are opened through it.
"""

from __future__ import annotations

import fnmatch
import io
from pathlib import PurePosixPath

from pyarrow import fs as pafs


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    text = str(path)
    if "://" in text:
        return pafs.FileSystem.from_uri(text)
    return pafs.LocalFileSystem(), text


def exists(path: str) -> bool:
    fs, p = resolve(path)
    return fs.get_file_info(p).type != pafs.FileType.NotFound


def is_folder(path: str) -> bool:
    fs, p = resolve(path)
    return fs.get_file_info(p).type == pafs.FileType.Directory


def size_of(path: str) -> int:
    fs, p = resolve(path)
    return fs.get_file_info(p).size


def open_read(path: str) -> io.BufferedReader:
    fs, p = resolve(path)
    if not exists(path):
        raise FileNotFoundError(path)
    return io.BufferedReader(fs.open_input_file(p), 1 << 18)


def open_write(path: str) -> io.BufferedWriter:
    fs, p = resolve(path)
    return io.BufferedWriter(fs.open_output_stream(p, compression=None), 1 << 18)


def move(source: str, target: str) -> None:
    fs, a = resolve(source)
    fs.move(a, resolve(target)[1])


def remove(path: str) -> None:
    fs, p = resolve(path)
    fs.delete_file(p)


def make_folder(path: str) -> None:
    fs, p = resolve(path)
    fs.create_dir(p, recursive=True)


def found(path: str, pattern: str = "*") -> list[str]:
    """The files of a folder that fit ``pattern``, or those that a path with ``*`` or ``?`` stands for, or the path itself; sorted."""
    fs, p = resolve(path)
    scheme = str(path)[: len(str(path)) - len(p)] if str(path).endswith(p) else ""
    if is_folder(path):
        folder = p
    elif any(c in p for c in "*?"):
        folder, pattern = str(PurePosixPath(p).parent), PurePosixPath(p).name
    else:
        return [str(path)] if exists(path) else []
    infos = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(scheme + i.path for i in infos if i.type == pafs.FileType.File and fnmatch.fnmatch(i.base_name, pattern))
