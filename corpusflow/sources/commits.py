"""Files that a writer either has to itself or not at all, on any store that Spark writes to.

They go through Hadoop's file systems as the session has them configured (not available over Connect).
"""

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class CommitConflict(Exception):
    """Another writer has taken the name."""


def file_system(spark: SparkSession, name: str):
    """Hadoop's file system of a path, and the path: works for any store that Spark writes to (not over Connect)."""
    file = spark._jvm.org.apache.hadoop.fs.Path(name)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()), file


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    system, path = file_system(spark, folder)
    if not system.exists(path):
        return []
    return [s.getPath().getName() for s in system.listStatus(path)]


def create_file(spark: SparkSession, name: str, text: str) -> None:
    """A new file with its whole content at once, or CommitConflict if the name is taken: written under
    another name and renamed, which refuses a name that is there. A writer that is lost on the way
    leaves a file that no reader looks at, and the name free."""
    folder, _, last = name.rpartition("/")
    system, path = file_system(spark, f"{folder}/_{last}-{uuid.uuid4().hex}")
    out = system.create(path, False)
    out.write(bytearray(text.encode()))
    out.close()
    fs = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
    try:
        context = fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())
        context.rename(system.makeQualified(path), system.makeQualified(fs.Path(name)), options)
    except Py4JJavaError as error:
        system.delete(path, False)
        if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
            raise CommitConflict(name) from error
        raise


def read_file(spark: SparkSession, name: str) -> str:
    rows = spark.read.text(name, wholetext=True).collect()  # one small file
    return rows[0][0] if rows else ""
