"""Files below a folder, listed and read by tasks.

Folders are listed level by level, each level's folders dealt to tasks, so the names are never on the
driver; contents are read in tasks of even numbers of files. Empty files are files like others. The store
is reached through `pyarrow.fs` (local, HDFS, S3 and alike).
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.session import materialize

# Bytes of files that a reading task is given about, and those that it holds at once.
TASK_BYTES, HELD_BYTES, HELD_FILES = 64 << 20, 8 << 20, 256


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified) of all files below a folder; path is relative to it. Names that begin with a dot or an
    underscore are passed over, as Spark does. A folder that is not there has no files."""
    from pyarrow import fs

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                inside = system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True))
                shown = [i for i in inside if i.base_name[0] not in "._"]
                columns = [
                    pa.array([f"{folder}/{i.base_name}".lstrip("/") for i in shown], pa.string()),
                    pa.array([i.is_file for i in shown], pa.bool_()),
                    pa.array([i.size if i.is_file else 0 for i in shown], pa.int64()),
                    pa.array([(i.mtime_ns or 0) // 1000 for i in shown], pa.int64()).cast(pa.timestamp("us", "UTC")),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "is_file", "size", "modified"])

    tasks, levels = spark.sparkContext.defaultParallelism, []
    folders = spark.createDataFrame([("",)], "path string")
    while True:
        found = folders.repartition(tasks, "path").mapInArrow(listed, "path string, is_file boolean, size long, modified timestamp")
        found = materialize(found, "listed")
        levels.append(found.filter("is_file").drop("is_file"))
        folders = found.filter("not is_file").select("path")
        if folders.isEmpty():
            break
    files = levels[0]
    for level in levels[1:]:
        files = files.unionByName(level)
    return files


def read_files(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """(path, content, modified) of listed files, a bounded number of bytes at a time besides a longer file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        for batch in batches:
            rows, size = [], 0
            for i, path in enumerate(batch.column("path").to_pylist()):
                with system.open_input_stream(f"{base}/{path}") as stream:
                    rows.append((i, stream.read()))
                size += len(rows[-1][1])
                if size >= HELD_BYTES or len(rows) >= HELD_FILES:
                    yield _content(batch, rows)
                    rows, size = [], 0
            if rows:
                yield _content(batch, rows)

    total = files.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    tasks = max((total["size"] or 0) // TASK_BYTES, min(total["n"], spark.sparkContext.defaultParallelism), 1)
    return files.select("path", "modified").repartition(tasks, "path").mapInArrow(run, "path string, content binary, modified timestamp")


def write_files(contents: DataFrame, root: str) -> None:
    """Write rows (path, content) as files below a folder, each by its task: under another name first, so a task
    that runs again leaves whole files only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        made = set()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                folder, _, name = f"{base}/{path}".rpartition("/")
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{folder}/_{name}") as out:
                    out.write(content or b"")
                system.move(f"{folder}/_{name}", f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    contents.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _content(batch: pa.RecordBatch, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    of = batch.take(pa.array([i for i, _ in rows]))
    columns = [of.column("path"), pa.array([data for _, data in rows], pa.binary()), of.column("modified")]
    return pa.RecordBatch.from_arrays(columns, names=["path", "content", "modified"])
