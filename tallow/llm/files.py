"""Files that executors write and read themselves, in the shared checkpoint folder."""

from __future__ import annotations

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder URI."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> str:
    system, path = open_folder(uri)
    system.create_dir(path, recursive=True)
    return uri
