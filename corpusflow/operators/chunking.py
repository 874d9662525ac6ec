"""Overlapping fixed-width character chunks and their metadata."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_SIZE = 1500
CHUNK_OVERLAP = 200

# A text is cut into stretches of so many chunks, those into shorter ones, and these into
# chunks. `substring` walks from the start of its input, so cutting every chunk straight out of
# a long text would take quadratic time.
_STRETCHES = (1024, 32, 1)


def chunk_count(length: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Number of chunks of a text of the given length in characters."""
    more = F.ceil((length - size) / F.lit(size - overlap)).cast("int")
    return (
        F.when(F.coalesce(length, F.lit(0)) == 0, F.lit(0))
        .when(length <= size, F.lit(1))
        .otherwise(more + 1)
    )


def chunk_text(
    df: DataFrame,
    text_col: str = "content",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """One row per chunk: the other columns, `chunk_index` (from 0) and `chunk_text`.

    Chunks start every `size - overlap` characters; the last one may be shorter. Empty text
    gives no row.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("chunking needs 0 <= overlap < size")
    step = size - overlap
    others = [c for c in df.columns if c != text_col]
    # The text may be a costly expression: it is computed in one projection, and no filter on its
    # length is left for the optimizer to copy it into.
    cut = df.select(
        *others, F.lit(0).alias("_first"), F.length(text_col).alias("_n"), F.col(text_col).alias("_part")
    ).withColumn("_n", chunk_count(F.col("_n"), size, overlap))
    for per in _STRETCHES:
        numbers = F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / per).cast("int"))
        cut = cut.withColumn("_s", F.explode(F.when(F.col("_n") > 0, numbers))).select(
            *others,
            (F.col("_first") + F.col("_s") * per).alias("_first"),
            F.least(F.lit(per), F.col("_n") - F.col("_s") * per).alias("_n"),
            F.substring("_part", F.col("_s") * (per * step) + 1, F.lit((per - 1) * step + size)).alias("_part"),
        )
    return cut.select(*others, F.col("_first").alias("chunk_index"), F.col("_part").alias("chunk_text"))


def with_chunk_metadata(
    chunks: DataFrame, path_prefix: str = "api_upload/", doc_type: str = ".md"
) -> DataFrame:
    """Add key, source path, title (name without its last suffix) and document type."""
    name = F.col("filename")
    return chunks.select(
        F.concat(name, F.lit("_"), F.col("chunk_index").cast("string")).alias("key"),
        *[c for c in chunks.columns if c not in ("chunk_index", "chunk_text")],
        F.concat(F.lit(path_prefix), name).alias("source_path"),
        F.regexp_replace(name, r"\.[^.]*\z", "").alias("title"),
        F.lit(doc_type).alias("doc_type"),
        "chunk_index",
        "chunk_text",
    )


def ingest_report(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks indexed per file, files without any chunk included.

    Both sides become counted rows of one aggregation: no join, and partial counts leave a
    much-repeated file name as one row per task.
    """
    marks = docs.select("filename", F.lit(0).alias("n")).unionByName(
        chunks.select("filename", F.lit(1).alias("n"))
    )
    return marks.groupBy("filename").agg(
        F.sum("n").alias("chunks_indexed"), F.lit("success").alias("status")
    )
