"""Ingest: documents to indexed chunk vectors."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, chunk_text, ingest_report, with_chunk_metadata
from corpusflow.operators.embedding import Embedder, embed
from corpusflow.functions.vectors import validate_vectors
from corpusflow.session import materialize
from corpusflow.sources.index import put
from corpusflow.sources.markdown import read_markdown


def chunk_documents(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks with key and metadata of documents(filename, content): row-wise, no shuffle.

    Tasks are as many as the scan has splits; set `spark.sql.files.maxPartitionBytes` or
    repartition the documents where these are too few."""
    return with_chunk_metadata(chunk_text(docs, "content", size, overlap))


def embed_documents(
    docs: DataFrame,
    embedder: Embedder | None = None,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Chunk vectors of documents, row-wise from scan to vector."""
    return embed(chunk_documents(docs, size, overlap), "chunk_text", embedder)


def ingest(
    spark: SparkSession,
    source: str,
    index: str,
    version: int,
    embedder: Embedder | None = None,
    replace_document: bool = False,
    dim: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Put a folder of markdown files into an index, all or nothing; (report, rejects).

    The files are read once: their chunks and the names of documents and rejects are written to
    the shared folder, and the index, the report and the rejects come from there. With `dim`,
    chunks whose vector has another size or a component that is not finite are rejected too;
    chunks without a vector (no words) stay, they have no hits.
    """
    docs, bad_files = read_markdown(spark, source)
    outcome = docs.withColumn("reason", F.lit(None).cast("string")).unionByName(bad_files, allowMissingColumns=True)
    read = materialize(outcome, "ingest-files")
    docs = read.filter("reason is null").select("filename", "content")
    rejects = read.filter("reason is not null").select("filename", "reason")
    vectors = materialize(embed_documents(docs, embedder).withColumn("version", F.lit(version).cast("long")), "ingest-vectors")
    if dim is not None:
        good, bad = validate_vectors(vectors, dim)
        empty = bad.filter("reason = 'missing vector'").drop("reason")
        rejects = rejects.unionByName(bad.filter("reason <> 'missing vector'").select("filename", "reason"))
        vectors = good.unionByName(empty)
    put(spark, index, vectors, replace_document)
    return ingest_report(docs.select("filename"), vectors), rejects
