"""Files in any store pyarrow reaches, opened inside tasks."""

from __future__ import annotations

import posixpath

from pyarrow import fs as pafs


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") or "://" not in uri:
        return pafs.LocalFileSystem(), uri.removeprefix("file://").removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    """Readers find the folder, empty, where no task has anything to write."""
    store, path = open_store(uri)
    store.create_dir(path, recursive=True)


def write_atomically(uri: str, attempt: str, chunks) -> int:
    """Write chunks under a name private to the attempt, then rename; returns the size."""
    store, path = open_store(uri)
    store.create_dir(posixpath.dirname(path), recursive=True)
    draft, size = f"{path}.{attempt}.tmp", 0
    with store.open_output_stream(draft) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    store.move(draft, path)
    return size
