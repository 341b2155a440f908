"""Files in the folder that all executors share, for formats Spark has no writer for."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write(uri: str, data: bytes) -> None:
    """The whole file or nothing: a task that is run again, or twice at once, leaves one good file."""
    system, path = _at(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as f:
        f.write(data)
    try:
        system.move(part, path)
    except OSError:
        # Some file systems refuse a name that is taken: another attempt of the task wrote the same bytes there.
        if system.get_file_info(path).type != fs.FileType.File or system.get_file_info(path).size != len(data):
            raise
        system.delete_file(part)


class Reader:
    """Range reads of a file; reads counts them."""

    def __init__(self, uri: str) -> None:
        system, path = _at(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()
        self.reads = 0

    def __call__(self, offset: int, length: int) -> bytes:
        self.reads += 1
        return self.file.read_at(length, offset)

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


def from_bytes(data: bytes):  # noqa: ANN201
    """A Reader's interface over bytes, for tests."""
    return lambda offset, length: data[offset : offset + length]
