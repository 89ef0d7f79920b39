"""Files that tasks write and read in the shared folder.

A task writes under a name of its own attempt; the manifest that Spark commits names the files
of the attempts that count. A repeated task leaves an unnamed file behind, never a wrong one.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def fresh_file(folder: str, suffix: str) -> str:
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}"


def write_file(uri: str, *parts: bytes) -> int:
    """Write the parts one after the other, creating the folder; the number of bytes."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        return sum(out.write(part) for part in parts)


def open_file(uri: str):
    """A seekable input file."""
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def read_file(uri: str) -> bytes:
    with open_file(uri) as source:
        return source.read()
