"""Whole files written and range-read by executors in a shared folder of any file system that Arrow knows."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs as arrow_fs


def located(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    uri = re.sub(r"^file:/+", "file:///", uri)
    if "://" not in uri:
        return arrow_fs.LocalFileSystem(), uri
    return arrow_fs.FileSystem.from_uri(uri)


def own_name(stem: str, suffix: str) -> str:
    """A name that no other attempt of the task uses: whatever attempts do, they never write one file twice.

    Readers go by a table of names that Spark has committed, so files of other attempts are never met.
    """
    return f"{stem}-{uuid.uuid4().hex}{suffix}"


def put(uri: str, parts: list[bytes]) -> None:
    """Write a file under a name of this attempt's own; nothing is renamed, which not every store can."""
    system, path = located(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as out:
        for part in parts:
            out.write(part)


class RangeFile:
    """A file read by ranges."""

    def __init__(self, uri: str):
        system, path = located(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        data = self.file.read(length)
        if len(data) != length:
            raise ValueError(f"{length} bytes asked for at {start}, {len(data)} found")
        return data

    def close(self) -> None:
        self.file.close()

    def __enter__(self) -> RangeFile:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
