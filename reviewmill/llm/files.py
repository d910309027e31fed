"""Files in the shared folder, written and read by tasks: any store that pyarrow reaches by URI."""

from __future__ import annotations

import uuid

from pyarrow import fs


def new_file(folder: str, stem: str, suffix: str) -> str:
    """A path of its own for each attempt at a task: what a lost or repeated attempt leaves behind is in no manifest."""
    return f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"


def create(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def open_random(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def open_mapped(uri: str):
    """A local file is mapped into memory, any other is read where it is asked for."""
    store, path = fs.FileSystem.from_uri(uri)
    return (fs.LocalFileSystem(use_mmap=True) if isinstance(store, fs.LocalFileSystem) else store).open_input_file(path)


def open_stream(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_stream(path, compression=None)
