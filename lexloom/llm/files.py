"""Binary files of a job in the shared folder, written by tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs


def store(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder (local, HDFS or an object store, as pyarrow knows them) and the path in it."""
    return fs.FileSystem.from_uri(root)


def fresh_name(prefix: str, suffix: str) -> str:
    """A name of its own for every attempt of a task, so a repeated task never writes into a file that is read."""
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"
