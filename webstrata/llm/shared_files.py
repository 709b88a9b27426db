"""Files in the shared folder that tasks write and read by themselves."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator


def filesystem(uri: str):
    """(file system, path) of a path or URI; a local path must be one that all executors mount."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def written(uri: str, attempt: int) -> Iterator:
    """A stream whose file takes its name only when it is complete; a repeated task replaces what an earlier one left."""
    files, path = filesystem(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    partial = f"{path}.{attempt}.partial"
    with files.open_output_stream(partial) as stream:
        yield stream
    files.move(partial, path)
