"""The cache of model replies: a table of Parquet files named by a log of commits, and journals of calls not yet committed.

A write's files count only when the next entry of the log names them, and an entry is made once: a task that failed after
its write, was repeated or ran twice adds its rows once. An entry that another run has made meanwhile makes the write fail; the
caller takes out the keys of the newer files and tries again, so each key stands in the table once. Every tenth entry
lists all files. A journal has each reply as it came, so that a broken-off run's calls aren't lost.
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sitewise import schemas
from sitewise.durable import delete_folder, forget, qualified, written
from sitewise.sources.staged import StagedFiles, Written, located, visible

#: Entries of the log between two that list all files, and attempts beside other runs.
WHOLE_EVERY, ATTEMPTS = 10, 20
CONFLICT = "another run has committed"
LOG, CALLS = "log", "calls"


@dataclass(frozen=True)
class State:
    """The number of the last commit, and the files of the table, or of the commits after a given one."""

    version: int
    files: tuple[str, ...]


def _entries(path: str) -> tuple[arrow_fs.FileSystem, str, list[int]]:
    fs, base = located(path)
    log = f"{base}/{LOG}"
    if fs.get_file_info(log).type != arrow_fs.FileType.Directory:
        return fs, log, []
    names = [f.base_name for f in fs.get_file_info(arrow_fs.FileSelector(log))]
    return fs, log, sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def state(path: str, since: int | None = None) -> State:
    """since: only what later commits have added. A folder without a log is a table of all its files."""
    fs, log, numbers = _entries(path)
    if not numbers:
        try:
            old = visible(path, ".parquet") if since is None else []
        except FileNotFoundError:
            old = []
        return State(0, tuple(f.rsplit("/", 1)[1] for f in old))
    files: list[str] = []
    for n in reversed([n for n in numbers if since is None or n > since]):
        with fs.open_input_stream(f"{log}/{n:012d}.json") as f:
            entry = json.loads(f.read())
        if since is None and "all" in entry:
            files += entry["all"]
            break
        files += entry["files"]
    return State(numbers[-1], tuple(files))


class ReplyWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.version = options["path"], int(options["version"])
        self.files, self.kind = StagedFiles(self.path, ".parquet", False), to_arrow_schema(schema)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        names, rows = [], 0
        with contextlib.ExitStack() as stack:
            writer = None
            for batch in iterator:
                if len(batch) and writer is None:
                    name, out = self.files.create()
                    names.append(name)
                    writer = stack.enter_context(pq.ParquetWriter(stack.enter_context(out), self.kind))
                if len(batch):
                    writer.write_table(pa.Table.from_batches([batch]).cast(self.kind))
                    rows += len(batch)
        return Written(names, rows)

    def commit(self, messages: list[Written | None]) -> None:
        known = state(self.path)
        if known.version != self.version:
            self.files.abort()
            raise RuntimeError(CONFLICT)
        names = self.files.commit(messages)
        entry: dict[str, object] = {"files": names}
        if (self.version + 1) % WHOLE_EVERY == 0 or self.version == 0:
            entry["all"] = [*known.files, *names]
        fs, base = located(self.path)
        fs.create_dir(f"{base}/{LOG}", recursive=True)
        made, final = f"{base}/{LOG}/.{uuid.uuid4().hex}", f"{base}/{LOG}/{self.version + 1:012d}.json"
        with fs.open_output_stream(made) as out:
            out.write(json.dumps(entry).encode())
        try:
            if isinstance(fs, arrow_fs.LocalFileSystem):
                os.link(made, final)  # fails if the entry is there
                os.unlink(made)
            elif fs.get_file_info(final).type != arrow_fs.FileType.NotFound:
                raise FileExistsError(final)
            else:
                fs.move(made, final)
        except FileExistsError:
            for n in names:
                fs.delete_file(f"{base}/{n}")
            raise RuntimeError(CONFLICT) from None

    def abort(self, messages: list[Written | None]) -> None:
        self.files.abort()


class ReplyDataSource(DataSource):
    """Format ``replies``, to append: options path and version, the last commit that the rows take into account."""

    @classmethod
    def name(cls) -> str:
        return "replies"

    def writer(self, schema: StructType, overwrite: bool) -> ReplyWriter:
        if overwrite:
            raise ValueError("replies are only added")
        return ReplyWriter(dict(self.options), schema)


def _table(spark: SparkSession, path: str, files: tuple[str, ...]) -> DataFrame:
    if not files:
        return spark.createDataFrame([], schemas.CACHE)
    return spark.read.schema(schemas.CACHE).parquet(*[f"{path}/{f}" for f in files])


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table, empty if nothing was written yet."""
    path = qualified(spark, path)
    return _table(spark, path, state(path).files)


def append_replies(rows: DataFrame, path: str, since: int) -> int:
    """Adds rows of different keys that the table of commit ``since`` lacks; keys that others have added meanwhile are left out. The new commit's number."""
    spark = rows.sparkSession
    spark.dataSource.register(ReplyDataSource)
    kept, new = written(rows, "replies"), None  # a reply is asked for once, however often its commit is tried
    try:
        for _ in range(ATTEMPTS):
            later = state(path, since)
            new = kept if later.version == since else kept.join(_table(spark, path, later.files).select("key"), "key", "left_anti")
            try:
                new.select("key", "wealth_score", "area_character", "confidence").write.format("replies").mode("append").options(path=path, version=later.version).save()
                return later.version + 1
            except Exception as e:
                if CONFLICT not in str(e):
                    raise
        raise RuntimeError(f"no commit beside other runs in {ATTEMPTS} attempts")
    finally:
        forget(kept)


class Journal:
    """The replies of a task as they came; a later attempt of the task finds those of the earlier ones."""

    def __init__(self, folder: str, task: str) -> None:
        self.fs, self.base = located(folder)
        self.task = task
        self.out = None

    def earlier(self) -> dict[str, str]:
        if self.fs.get_file_info(self.base).type != arrow_fs.FileType.Directory:
            return {}
        found = {}
        for f in self.fs.get_file_info(arrow_fs.FileSelector(self.base)):
            if f.base_name.startswith(f"{self.task}-"):
                with self.fs.open_input_stream(f.path) as lines:
                    for line in lines.read().split(b"\n"):
                        with contextlib.suppress(ValueError):  # the last line of a killed attempt
                            row = json.loads(line)
                            found[row["key"]] = row["raw"]
        return found

    def add(self, key: str, raw: str) -> None:
        if self.out is None:
            self.fs.create_dir(self.base, recursive=True)
            self.out = self.fs.open_output_stream(f"{self.base}/{self.task}-{uuid.uuid4().hex}.jsonl")
        self.out.write(json.dumps({"key": key, "raw": raw}).encode() + b"\n")
        self.out.flush()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def journalled(spark: SparkSession, path: str) -> tuple[DataFrame | None, list[str]]:
    """(key, raw) of the calls that broken-off runs have made, and the journals' folders; another run that still goes on loses nothing by their being read."""
    fs, base = located(f"{path}/{CALLS}")
    if fs.get_file_info(base).type != arrow_fs.FileType.Directory:
        return None, []
    folders = [f"{path}/{CALLS}/{f.base_name}" for f in fs.get_file_info(arrow_fs.FileSelector(base)) if f.type == arrow_fs.FileType.Directory]
    if not folders:
        return None, []
    return spark.read.schema("key string, raw string").json(folders).where("key is not null and raw is not null").dropDuplicates(["key"]), folders


def delete_journals(spark: SparkSession, folders: list[str]) -> None:
    for f in folders:
        delete_folder(spark, f)
