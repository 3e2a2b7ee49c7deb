"""Small files of the driver on any file system: manifests, reports, block lists, logs.

A path with a scheme (``file:``, ``hdfs:``, ``s3:``, ``gs:`` …) is opened by that file system, one without by the local one.
"""

from __future__ import annotations

import fnmatch
import os
import re

from pyarrow import fs


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if not re.match(r"[a-z][a-z0-9+.\-]*:", path):
        return fs.LocalFileSystem(), os.path.abspath(path)
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def join(path: str, *parts: str) -> str:
    return "/".join([path.rstrip("/"), *parts])


def exists(path: str) -> bool:
    where, p = locate(path)
    return where.get_file_info(p).type != fs.FileType.NotFound


def read_text(path: str) -> str:
    where, p = locate(path)
    with where.open_input_stream(p) as f:
        return f.read().decode("utf-8")


def write_text(path: str, text: str) -> None:
    where, p = locate(path)
    if "/" in p:
        where.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(p) as f:
        f.write(text.encode("utf-8"))


def list_names(path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    where, p = locate(path)
    return sorted(x.base_name for x in where.get_file_info(fs.FileSelector(p, allow_not_found=True)))


def list_files(path: str) -> list[str]:
    """Paths of the files of a folder, or that match a pattern of the last part, or of the one file; with the scheme of ``path``."""
    where, p = locate(path)
    head = path[: len(path) - len(p)] if path.endswith(p) else ("file://" if path.startswith("file:") else "")
    info = where.get_file_info(p)
    if info.type == fs.FileType.File:
        return [head + p]
    folder, pattern = (p, "*") if info.type == fs.FileType.Directory else (p.rsplit("/", 1)[0], p.rsplit("/", 1)[-1])
    found = where.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(head + x.path for x in found if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, pattern))


def delete(path: str) -> None:
    """Delete a file or a folder with all it holds; nothing if there is none."""
    where, p = locate(path)
    kind = where.get_file_info(p).type
    if kind == fs.FileType.Directory:
        where.delete_dir(p)
    elif kind != fs.FileType.NotFound:
        where.delete_file(p)
