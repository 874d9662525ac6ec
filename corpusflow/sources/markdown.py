"""Markdown documents from files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.schemas import BINARY_FILES
from corpusflow.sources.files import list_files, read_files

SUFFIX = ".md"


def _qualified(spark: SparkSession, path: str) -> str:
    """A folder's name as it begins the paths of its files."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/") + "/"


def named_files(files: DataFrame, root: str | None = None) -> DataFrame:
    """Binary files (path, content) as documents (filename, content) and rejects (filename, reason).

    A file is named by its path below `root`, so equal names in two folders stay apart; without
    a root, or outside it, by its last part. A document's name ends in `.md`, in that case, and its content is valid UTF-8; the text
    is taken as it is, byte order mark and line ends included. Other columns are kept.
    """
    text = F.col("content").cast("string")
    reason = F.when(~F.col("filename").endswith(SUFFIX), F.lit("not a .md file")).when(
        ~F.is_valid_utf8(text), F.lit("not valid UTF-8")
    )
    name = F.regexp_extract("path", r"[^/]*\z", 0)
    if root is not None:
        below = F.substring("path", len(root) + 1, 1 << 30)
        name = F.when(F.startswith("path", F.lit(root)), below).otherwise(name)
    others = [c for c in files.columns if c not in ("path", "length", "content")]
    named = files.withColumn("filename", name).withColumn("reason", reason)
    kept = F.when(F.col("reason").isNull(), text).alias("content")
    return named.select("filename", kept, *others, "reason")


def split_markdown(files: DataFrame, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of a table of binary files, see `named_files`."""
    named = named_files(files, root)
    return named.filter("reason is null").drop("reason"), named.filter("reason is not null").select("filename", "reason")


def read_markdown(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of the files below a folder, empty ones included; listed and read by tasks."""
    files = read_files(spark, path, list_files(spark, path))
    return split_markdown(files.select("path", "content"), "")


def scan_markdown(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """As `read_markdown` by Spark's own file scan, for stores that nothing else reads; it leaves out empty files."""
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return split_markdown(scan.select("path", "content"), _qualified(spark, path))


def stream_markdown(
    spark: SparkSession, path: str, max_files_per_trigger: int = 1000
) -> tuple[DataFrame, DataFrame]:
    """(documents with their modification time, rejects) of the files arriving below a folder.

    Two streams, each started by itself, with the names and the outcomes of `read_markdown`; only
    files without content never arrive, Spark's file stream passes them over."""
    return split_markdown(_arriving(spark, path, max_files_per_trigger), _qualified(spark, path))


def stream_files(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """The files arriving below a folder as one stream: (filename, content, modificationTime) of documents, and
    (filename, reason) of rejects."""
    return named_files(_arriving(spark, path, max_files_per_trigger), _qualified(spark, path))


def _arriving(spark: SparkSession, path: str, max_files_per_trigger: int) -> DataFrame:
    return (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILES)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(path)
    )
