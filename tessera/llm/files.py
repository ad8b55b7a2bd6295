"""Binary files in the shared folder, from executors, through whatever file system its address names."""

from __future__ import annotations

import uuid

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of an address such as file:///..., hdfs://... or s3://..."""
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def new_file(folder: str, part: int, suffix: str):
    """A stream to a new file, and its address.

    The name is new for each task attempt, and only names that Spark's own commit lets through are read later, so an
    attempt that was lost or repeated leaves at most a file that nobody reads.
    """
    system, path = place(folder)
    system.create_dir(path, recursive=True)
    name = f"part-{part:06d}-{uuid.uuid4().hex}{suffix}"
    return system.open_output_stream(f"{path}/{name}", compression=None), f"{folder}/{name}"


def read_range(uri: str, start: int, end: int) -> bytes:
    system, path = place(uri)
    with system.open_input_file(path) as f:
        return f.read_at(end - start, start)


def open_at(uri: str, start: int):
    """A stream that reads a file from ``start`` on."""
    system, path = place(uri)
    f = system.open_input_file(path)
    f.seek(start)
    return f


class Opened:
    """Ranges of many files, a few of which are kept open."""

    MOST = 32

    def __enter__(self):
        self.streams = {}
        return self

    def __exit__(self, *_):
        for f in self.streams.values():
            f.close()

    def read(self, uri: str, start: int, size: int) -> bytes:
        if uri not in self.streams:
            if len(self.streams) >= self.MOST:
                self.streams.pop(next(iter(self.streams))).close()
            system, path = place(uri)
            self.streams[uri] = system.open_input_file(path)
        return self.streams[uri].read_at(size, start)
