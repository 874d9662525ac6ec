"""Declared schemas; nothing in the package infers one."""

from pyspark.sql import types as T

CHUNKS = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("doc_type", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("chunk_text", T.StringType()),
    ]
)

VECTORS = T.StructType(
    CHUNKS.fields
    + [
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("version", T.LongType()),
    ]
)

# Metadata that a hit carries next to its key and distance.
METADATA = ["title", "source_path", "doc_type", "chunk_index", "chunk_text"]

# Binary files as Spark's own reader presents them.
BINARY_FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

# `seq` is the 0-based, gap-free position of a message in its session.
MESSAGES = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
    ]
)

# One message inside a transcript file.
TRANSCRIPT_ENTRY = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("timestamp", T.StringType()),
    ]
)
