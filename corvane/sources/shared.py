"""Whole small files in a shared folder, written by tasks: a path with file:// or none is the local file system's, others Arrow's."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyarrow import fs as pafs


def _local(path: str) -> str | None:
    where = urlparse(path)
    return where.path if where.scheme in ("", "file") else None


def write(path: str, content: bytes) -> None:
    """The file with its content, whole or not at all: written under another name first."""
    folder, _, name = path.rpartition("/")
    temporary = f"{folder}/.{name}.{uuid.uuid4().hex}"
    if (at := _local(temporary)) is not None:
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "wb") as f:
            f.write(content)
        os.replace(at, _local(path))
        return
    fs, at = pafs.FileSystem.from_uri(temporary)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at) as f:
        f.write(content)
    fs.move(at, pafs.FileSystem.from_uri(path)[1])


def read(path: str) -> bytes | None:
    if (at := _local(path)) is not None:
        try:
            with open(at, "rb") as f:
                return f.read()
        except FileNotFoundError:
            return None
    fs, at = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(at).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(at) as f:
        return f.read()


def claim(temporary: str, path: str) -> bool:
    """Gives a finished file its name; false, and the file stays as it is, where the name is taken.

    Two writers at once get two names on a local or mounted file system; elsewhere the last of them may win.
    """
    if (at := _local(temporary)) is not None:
        try:
            os.link(at, _local(path))
        except FileExistsError:
            return False
        os.unlink(at)
        return True
    fs, at = pafs.FileSystem.from_uri(temporary)
    target = pafs.FileSystem.from_uri(path)[1]
    if fs.get_file_info(target).type != pafs.FileType.NotFound:
        return False
    fs.move(at, target)
    return True


def remove(path: str) -> None:
    if (at := _local(path)) is not None:
        if os.path.exists(at):
            os.unlink(at)
        return
    fs, at = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(at).type != pafs.FileType.NotFound:
        fs.delete_file(at)
