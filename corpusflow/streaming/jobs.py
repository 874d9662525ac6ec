"""Structured Streaming forms of ingest, history and retrieval."""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from corpusflow.operators.chunking import ingest_report
from corpusflow.operators.conversation import HISTORY_MESSAGES, touched_histories
from corpusflow.operators.embedding import Embedder
from corpusflow.plans.ingest import embed_documents
from corpusflow.plans.retrieve import retrieve
from corpusflow.schemas import VECTORS
from corpusflow.sources import index as index_store
from corpusflow.sources import message_log
from corpusflow.sources.index import read_if_there


def stream_ingest(
    docs: DataFrame, index: str, checkpoint: str, embedder: Embedder | None = None
) -> StreamingQuery:
    """Append the chunk vectors of arriving documents(filename, content, modificationTime) to
    the index log.

    Row-wise work into a folder per batch, named after the stream's checkpoint. `compact` folds
    the log into the next snapshot when it suits, so a small batch does not rewrite the index.

    What became of each file is written beside, counted from what the batch has appended: documents and,
    where the stream has a column `reason` (as of `stream_files`), rejects. See `ingest_outcomes`.
    """
    stream = stream_name(checkpoint)

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if "reason" not in batch.columns:
            batch = batch.withColumn("reason", F.lit(None).cast("string"))
        arrived = batch.filter("reason is null")
        versioned = arrived.withColumn("version", F.unix_micros("modificationTime")).drop("modificationTime", "reason")
        vectors = embed_documents(versioned, embedder).select(*VECTORS.names)
        index_store.append_log(vectors, index, stream, number)
        appended = spark.read.schema(VECTORS).parquet(f"{index}/log/stream={stream}/batch={number}")
        report = ingest_report(arrived.select("filename"), appended).withColumn("reason", F.lit(None).cast("string"))
        rejected = batch.filter("reason is not null").select("filename", "reason").withColumn("status", F.lit("rejected"))
        outcomes = report.unionByName(rejected, allowMissingColumns=True)
        outcomes.write.mode("overwrite").parquet(f"{index}/outcomes/stream={stream}/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_outcomes(spark: SparkSession, index: str) -> DataFrame:
    """(filename, chunks_indexed, status, reason, searchable) of every file that streams have brought: `searchable`
    once the snapshot readers see has its batch."""
    schema = "filename string, chunks_indexed bigint, status string, reason string, stream string, batch bigint"
    rows = spark.read.schema(schema).parquet(f"{index}/outcomes")
    snapshot = index_store.current_snapshot(spark, index)
    folded = list(snapshot.folded.items()) if snapshot else []  # one position for each stream
    ends = F.broadcast(spark.createDataFrame(folded, "stream string, folded bigint"))
    searchable = F.coalesce(F.col("batch") <= F.col("folded"), F.lit(False)) & (F.col("status") != "rejected")
    return rows.join(ends, "stream", "left").withColumn("searchable", searchable).drop("stream", "batch", "folded")


def stream_name(checkpoint: str) -> str:
    """What a stream is called in logs: by its checkpoint, which it keeps when it is started again."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def stream_history(messages: DataFrame, path: str, checkpoint: str, n: int = HISTORY_MESSAGES) -> StreamingQuery:
    """Keep the histories of all user turns up to date with arriving messages(session_id, seq, role, content).

    Each batch is appended to the message log below `path`, and the histories that it touches are made
    again from the log: a message that comes late, or into a gap, also changes those of the turns after
    it. `read_histories` gives the last form of each. There is no state but the log; a batch that runs again is
    appended once and replaces its own histories.
    """
    schema = message_log.logged(messages.select("session_id", F.col("seq").cast("int").alias("seq"), "role", "content").schema)

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("seq", F.col("seq").cast("int"))
        message_log.append_messages(spark, f"{path}/messages", batch, schema, stream_name(checkpoint), number)
        stored = message_log.read_log(spark, f"{path}/messages", schema=schema)
        touched = touched_histories(stored, batch, n)
        touched.write.mode("overwrite").parquet(f"{path}/histories/batch={number}")

    return messages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_histories(spark: SparkSession, path: str, session_type: T.DataType = T.StringType()) -> DataFrame:
    """(session_id, seq, roles, contents) of all user turns, as the last batch that touched them left them."""
    texts = T.ArrayType(T.StringType())
    fields = [("session_id", session_type), ("seq", T.IntegerType()), ("roles", texts), ("contents", texts), ("batch", T.LongType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    rows = read_if_there(spark.read.schema(schema).parquet, f"{path}/histories")
    if rows is None:  # no batch has been run yet
        return spark.createDataFrame([], schema).drop("batch")
    last = rows.groupBy("session_id", "seq").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["session_id", "seq", "batch"], "left_semi").drop("batch")


def stream_retrieve(
    queries: DataFrame, vectors: DataFrame, path: str, checkpoint: str, **options
) -> StreamingQuery:
    """Source rows for arriving queries(query_id, query, embedding) against a fixed index.

    Each batch is written below its own number: a batch run again replaces its own output.
    """

    def answer(batch: DataFrame, number: int) -> None:
        retrieve(batch, vectors, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
