"""One JSON file for each session, written and read by tasks as a Python data source.

A file `{session}.json` is an array of entries with role, content and timestamp. A task streams the sorted
messages of its sessions into files of its own folder, so no session is ever one row. The job's
commit lists the folders of the attempts that count; after that the files are moved to their place by
tasks, and a move that was cut short is finished by the next writer or reader.

Files are reached through `pyarrow.fs` (local, HDFS, S3 and alike), in tasks.
"""

import codecs
import json
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "transcript_files"
READ_TASKS = 32
_STAGED = "_staged"
_COMMITTED = "_committed"
_AT_ONCE, _CHUNK = 5000, 1 << 20
_ROW = "session_id string, seq int, role string, content string, timestamp string"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def file_name(session: str) -> str:
    """The file of a session; an id that cannot be a file's name is an error."""
    if not session or "/" in session or "\0" in session:
        raise ValueError(f"not a session id for a file: {session!r}")
    return f"{session}.json"


@dataclass
class _Attempt(WriterCommitMessage):
    folder: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.job = options["path"], options["job"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Attempt:
        system, root = _open(self.path)
        attempt = uuid.uuid4().hex
        folder = f"{root}/{_STAGED}/{self.job}/{attempt}"
        system.create_dir(folder, recursive=True)
        session, out = None, None
        for batch in iterator:
            for row in batch.to_pylist():
                first = out is None or row["session_id"] != session
                if first:
                    self._end(out)
                    session, name = row["session_id"], file_name(row["session_id"])
                    out = system.open_output_stream(f"{folder}/{name}")
                entry = json.dumps({"role": row["role"], "content": row["content"], "timestamp": row["timestamp"]}, indent=2)
                out.write((("[" if first else ",") + "\n  " + entry.replace("\n", "\n  ")).encode())
        self._end(out)
        return _Attempt(attempt)

    @staticmethod
    def _end(out) -> None:
        if out is not None:
            out.write(b"\n]")
            out.close()

    def commit(self, messages: list[_Attempt | None]) -> None:
        system, root = _open(self.path)
        with system.open_output_stream(f"{root}/{_STAGED}/{self.job}/{_COMMITTED}") as out:
            out.write(json.dumps([m.folder for m in messages if m]).encode())

    def abort(self, messages: list[_Attempt | None]) -> None:
        system, root = _open(self.path)
        system.delete_dir_contents(f"{root}/{_STAGED}/{self.job}", missing_dir_ok=True)


@dataclass
class _Share(InputPartition):
    number: int


def entries(stream) -> Iterator[dict]:
    """The objects of a JSON array, parsed as they are read; anything else is an error."""
    decoder, utf8, text, at, more = json.JSONDecoder(), codecs.getincrementaldecoder("utf-8")(), "", 0, _CHUNK
    opened = closed = done = need_comma = False

    def skip() -> None:
        nonlocal at
        while at < len(text) and text[at] in " \t\r\n":
            at += 1

    while True:
        skip()
        if at < len(text):
            c = text[at]
            if closed or (not opened and c != "["):
                raise ValueError("not a JSON array of messages")
            if not opened:
                opened, at = True, at + 1
                continue
            if c == "]":
                closed, at = True, at + 1
                continue
            if need_comma:
                if c != ",":
                    raise ValueError("not a JSON array of messages")
                need_comma, at = False, at + 1
                continue
            try:
                entry, end = decoder.raw_decode(text, at)
            except json.JSONDecodeError:
                if done:
                    raise
            else:
                if not isinstance(entry, dict):
                    raise ValueError("not a JSON array of messages")
                yield entry
                at, need_comma, more = end, True, _CHUNK
                continue
        if done:
            if not closed:
                raise ValueError("the JSON array does not end")
            return
        data = stream.read(more)
        done, more = not data, 2 * more  # a long entry is tried a few times only
        text, at = text[at:] + utf8.decode(data, final=not data), 0


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.tasks = options["path"], int(options.get("tasks", READ_TASKS))

    def partitions(self) -> list[_Share]:
        return [_Share(i) for i in range(self.tasks)]

    def read(self, partition: _Share) -> Iterator[pa.RecordBatch]:
        """Every task lists the folder and takes the names that its number falls on."""
        from pyarrow import fs

        system, root = _open(self.path)
        names = ["session_id", "seq", "role", "content", "timestamp"]
        types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            name = info.base_name
            if not info.is_file or not name.endswith(".json") or zlib.crc32(name.encode()) % self.tasks != partition.number:
                continue
            with system.open_input_stream(info.path) as stream:
                for seq, entry in enumerate(entries(stream)):
                    rows.append((name[:-5], seq, entry.get("role"), entry.get("content"), entry.get("timestamp")))
                    if len(rows) >= _AT_ONCE:
                        yield batch()
                        rows = []
        if rows:
            yield batch()


class TranscriptFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _ROW

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options)

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options)


def write_transcript_files(messages: DataFrame, path: str) -> None:
    """Write each session of messages(session_id, seq, role, content, timestamp) as `{session}.json`.

    A session written before is replaced as a whole, sessions not among `messages` stay. Until all
    tasks have finished, nothing of the folder's files has changed.
    """
    spark = messages.sparkSession
    _register(spark)
    publish(spark, path)
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")
    rows = messages.select(F.col("session_id").cast("string").alias("session_id"), "seq", "role", "content", stamp)
    ordered = rows.repartition("session_id").sortWithinPartitions("session_id", "seq")
    job = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    ordered.write.format(FORMAT).mode("append").option("job", job).save(path)
    publish(spark, path)


def publish(spark: SparkSession, path: str) -> None:
    """Move the files of finished jobs to their place, in the jobs' order; a task for each attempt's folder.
    Moving twice changes nothing, so a publication that was cut short is done again."""
    from pyarrow import fs

    system, root = _open(path)
    jobs = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(f"{root}/{_STAGED}", allow_not_found=True)))

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _open(path)
        for batch in batches:
            for folder in batch["folder"]:
                files = system.get_file_info(fs.FileSelector(f"{root}/{_STAGED}/{folder}", allow_not_found=True))
                for info in files:
                    system.move(info.path, f"{root}/{info.base_name}")
                yield pd.DataFrame({"n": [len(files)]})

    for job in jobs:
        marker = f"{root}/{_STAGED}/{job}/{_COMMITTED}"
        if not system.get_file_info(marker).is_file:
            continue
        with system.open_input_stream(marker) as stream:
            folders = [(f"{job}/{attempt}",) for attempt in json.loads(stream.read())]
        if folders:
            rows = spark.createDataFrame(folders, "folder string").repartition(len(folders))
            rows.mapInPandas(move, "n long").agg(F.sum("n")).collect()
        system.delete_dir(f"{root}/{_STAGED}/{job}")


def read_transcript_files(spark: SparkSession, path: str, tasks: int = READ_TASKS) -> DataFrame:
    """(session_id, seq, role, content, timestamp) of the files `{session}.json` of a folder, a bounded
    number of messages at a time; a malformed file is an error."""
    _register(spark)
    publish(spark, path)
    rows = spark.read.format(FORMAT).option("tasks", tasks).load(path)
    return rows.withColumn("timestamp", F.to_timestamp_ntz("timestamp"))


def _register(spark: SparkSession) -> None:
    spark.dataSource.register(TranscriptFiles)
