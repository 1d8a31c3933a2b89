"""Files in the shared folder, opened from inside tasks by URI."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _resolve(uri: str):
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (
        fs.LocalFileSystem(), uri)


def new_file(folder: str, part: int, suffix: str) -> str:
    """A name no other attempt of the same task uses; the committed attempt's rows carry it."""
    return f"{folder.rstrip('/')}/part-{part:06d}-{uuid.uuid4().hex}{suffix}"


def open_output(uri: str):
    system, path = _resolve(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_input(uri: str):
    system, path = _resolve(uri)
    return system.open_input_file(path)
