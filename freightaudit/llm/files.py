"""Flat files that tasks write to and read from the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs


@contextmanager
def new_file(folder: str, suffix: str) -> Iterator[tuple[str, pa.NativeFile]]:
    """A file of a new name in ``folder``, open for writing.  A task that is run again writes a
    file of another name; only names that a task has returned count."""
    uri = f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}"
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        yield uri, out


def open_file(uri: str) -> pa.NativeFile:
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def put_file(uri: str, data: bytes) -> None:
    """``data`` as a file of a given name, whole or not at all.  A task that is run again makes the
    same bytes under the same name, so a file that is there already stays."""
    store, path = fs.FileSystem.from_uri(uri)
    if store.get_file_info(path).type != fs.FileType.NotFound:
        return
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part, compression=None) as out:
        out.write(data)
    store.move(part, path)
