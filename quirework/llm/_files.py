"""Files of archives through pyarrow's file systems: local, mounted, hdfs:// or object stores, by their URI."""

from __future__ import annotations

import os

from pyarrow import fs as pafs


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path in it; without a scheme, or with file:, it is a local one."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def listed(path: str, ending: str) -> list[tuple[str, int]]:
    """Paths (with the scheme of `path`) and sizes of the files of a folder with an ending, by name; none if it isn't there."""
    fs, root = resolve(path)
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted((f"{path.rstrip('/')}/{f.base_name}", f.size) for f in found if f.is_file and f.base_name.endswith(ending) and not f.base_name.startswith("_"))


def base_name(path: str) -> str:
    return path.rpartition("/")[2]


def open_input(path: str):
    fs, p = resolve(path)
    return fs.open_input_file(p)


def create(path: str):
    """A stream into a new file; its folder is made."""
    fs, p = resolve(path)
    fs.create_dir(p.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(p, compression=None)


def move(old: str, new: str) -> None:
    fs, a = resolve(old)
    fs.move(a, resolve(new)[1])


def remove(path: str) -> None:
    fs, p = resolve(path)
    if fs.get_file_info(p).is_file:
        fs.delete_file(p)
