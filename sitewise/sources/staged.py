"""Files that tasks write and that belong to a table only when the whole write is committed.

A task's files lie in a hidden folder of the write; the commit messages of the tasks that count name them.
So files of failed, repeated or speculative attempts never show, and go when the write ends. Paths are URIs that
pyarrow knows, or plain paths on a file system that the driver and all executors share.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: file names and rows."""

    names: list[str]
    rows: int


def located(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path, and the path there."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(path)


def visible(path: str, suffix: str) -> list[str]:
    """The files of a table in order of their names; a path of a single file is that file."""
    fs, base = located(path)
    info = fs.get_file_info(base)
    if info.type == arrow_fs.FileType.File:
        return [base]
    if info.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = fs.get_file_info(arrow_fs.FileSelector(base))
    return sorted(f.path for f in found if f.type == arrow_fs.FileType.File and f.base_name.endswith(suffix) and f.base_name[0] not in "._")


class StagedFiles:
    """One write: names new files, and shows them on commit. Goes to the tasks as it is."""

    def __init__(self, path: str, suffix: str, overwrite: bool) -> None:
        self.path, self.suffix, self.overwrite, self.write_id = path, suffix, overwrite, uuid.uuid4().hex

    def _staging(self) -> tuple[arrow_fs.FileSystem, str, str]:
        fs, base = located(self.path)
        return fs, base, f"{base}/_staging-{self.write_id}"

    def create(self) -> tuple[str, object]:
        """A new file's name and an output stream."""
        fs, _, staging = self._staging()
        fs.create_dir(staging, recursive=True)
        name = f"part-{uuid.uuid4().hex}{self.suffix}"
        return name, fs.open_output_stream(f"{staging}/{name}")

    def commit(self, messages: list[Written | None]) -> list[str]:
        fs, base, staging = self._staging()
        fs.create_dir(base, recursive=True)
        old = visible(self.path, self.suffix) if self.overwrite else []
        names = [n for m in messages if m is not None for n in m.names]
        for n in names:
            fs.move(f"{staging}/{n}", f"{base}/{n}")
        for f in old:
            fs.delete_file(f)
        self.abort()
        return names

    def abort(self) -> None:
        fs, _, staging = self._staging()
        if fs.get_file_info(staging).type == arrow_fs.FileType.Directory:
            fs.delete_dir(staging)
