"""Open and list files from tasks, by the same paths Spark reports."""

from __future__ import annotations

import os

import pyarrow.fs as pafs


def plain_path(path: str) -> str:
    """A local path without its scheme; any other path as it is."""
    return "/" + path[len("file:") :].lstrip("/") if path.startswith("file:") else path


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a local path or URI (file, hdfs, s3, gs …)."""
    path = path if path == "/" else path.rstrip("/")
    path = plain_path(path)
    if path.startswith(("s3a://", "s3n://")):
        path = "s3" + path[3:]
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def open_file(path: str):
    """A seekable handle; reads fetch only the ranges asked for."""
    fs, inner = filesystem(path)
    return fs.open_input_file(inner)


def list_sizes(path: str) -> dict[str, int]:
    """Size of every file at or below a path; empty when nothing is there."""
    path = path.rstrip("/")
    fs, inner = filesystem(path)
    scheme = path[: -len(inner)] if "://" in path and path.endswith(inner) else ""
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return {scheme + inner: info.size}
    if info.type == pafs.FileType.Directory:
        entries = fs.get_file_info(pafs.FileSelector(inner, recursive=True))
        return {scheme + e.path: e.size for e in entries if e.type == pafs.FileType.File}
    return {}


def list_entries(path: str) -> list[tuple[str, int, bool, int | None]]:
    """Path, size, whether it is a folder, and time of change of what lies in a folder, or of a file itself.

    Paths are written as Spark writes them: local ones with the scheme ``file:``. A link to a folder is
    left out, so a loop of links ends; a folder that has gone meanwhile is empty.
    """
    fs, inner = filesystem(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        return []
    entries, local = [info], isinstance(fs, pafs.LocalFileSystem)
    if info.type == pafs.FileType.Directory:
        entries = fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True))
    scheme = "file:" if local or "://" not in path else path[: path.index("://") + 3]
    host = "" if scheme == "file:" or not path.startswith(scheme) else _host_of(path, inner)
    found = []
    for e in entries:
        folder = e.type == pafs.FileType.Directory
        if e.type != pafs.FileType.NotFound and not (folder and local and os.path.islink(e.path)):
            found.append((scheme + host + e.path, e.size or 0, folder, e.mtime_ns))
    return found


def _host_of(path: str, inner: str) -> str:
    """What a URI has between its scheme and the path inside the file system."""
    rest = path.rstrip("/").split("://", 1)[1]
    return rest.removesuffix(inner) if rest.endswith(inner) else ""


def path_exists(path: str) -> bool:
    fs, inner = filesystem(path)
    return fs.get_file_info(inner).type != pafs.FileType.NotFound
